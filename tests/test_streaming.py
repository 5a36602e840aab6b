"""Stateful streams against what the batch forms give."""

import datetime as dt
import random
import uuid

from lodestone.operators import events
from lodestone.streaming import stateful


def run(spark, tmp_path, batches, schema, build):
    """All rows that a stream gives for files that arrive one after the other."""
    source = tmp_path / uuid.uuid4().hex
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i:03d}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"t{uuid.uuid4().hex}"
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert query.exception() is None
    return spark.table(name).collect()


def test_safe_release(spark, tmp_path):
    rng = random.Random(2)
    log = [(i, rng.choice("ab"), i // 2 + rng.randrange(1, 4)) for i in range(40)]
    want = {r.arrival: r.released_at for r in events.safe_release(spark.createDataFrame(log, "arrival long, node string, time long"), ["a", "b"]).collect()}
    rows = [("l", *x, str(x[0])) for x in log]
    got = run(spark, tmp_path, [rows[:15], rows[15:]], "log string, arrival long, node string, time long, action string", lambda s: stateful.safe_release(s, ["a", "b"]))
    assert {int(r.action): r.released_at for r in got} == {k: v for k, v in want.items() if v is not None}
    assert [r.time for r in got] == sorted(r.time for r in got)


def test_causal_delivery(spark, tmp_path):
    rows = [("r", 1, "b", {"a": 1}, "second"), ("r", 2, "a", {}, "first"), ("r", 3, "c", {"z": 1}, "never")]
    got = run(spark, tmp_path, [rows], "receiver string, arrival long, src string, clock map<string,int>, msg string", stateful.causal_delivery)
    assert [(r.msg, r.released_at) for r in got] == [("first", 2), ("second", 2)]


def test_newest_and_suspicions(spark, tmp_path):
    rows = [("n", 1, 5, "a"), ("n", 2, 4, "b"), ("n", 3, 6, "c"), ("m", 4, 0, "d")]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], "node string, arrival long, seq long, value string", stateful.newest_only)
    assert sorted(r.value for r in got) == ["a", "c", "d"]
    beats = [("n", float(t)) for t in (0, 1, 5, 8, 14)]
    got = run(spark, tmp_path, [beats[:3], beats[3:]], "node string, ts double", lambda s: stateful.adaptive_suspicions(s, 2.0, 2.0))
    assert sorted((r.last, r.next, r.period) for r in got) == [(1.0, 5.0, 2.0), (8.0, 14.0, 4.0)]


def test_colours(spark, tmp_path):
    rows = [("n", i, 10 * i) for i in range(1, 5)]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], "node string, seq long, n long", stateful.colour_fold)
    want = events.colour_states(spark.createDataFrame(rows, "node string, seq long, n long")).first()
    last = max(got, key=lambda r: r.seq)
    assert (last.r, last.g, last.b) == (want.r, want.g, want.b)


def test_triangles(spark, tmp_path):
    pairs = [(a, b) for a in range(25) for b in range(a + 1, 25)]
    random.Random(3).shuffle(pairs)
    rows = [("g", i, a, b) for i, (a, b) in enumerate(pairs)]
    got = run(spark, tmp_path, [rows[:150], rows[150:]], "graph string, t long, src long, dst long", lambda s: stateful.triangle_estimates(s, 200, 200, 100))
    assert [r.t for r in sorted(got, key=lambda r: r.t)] == [100, 200, 300]
    k, n = stateful.estimate_triangles(pairs, 200, 400)
    assert 0.5 < k < 1.6 and 0.3 * 2300 < n < 2.5 * 2300


def test_timers_find_a_node_that_falls_silent(spark, tmp_path):
    at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)
    batches = [[("dead", at(0)), ("dead", at(1)), ("live", at(0))], [("live", at(100))], [("live", at(101))], [("back", at(102)), ("live", at(103))], [("back", at(150)), ("live", at(150))], [("live", at(151))]]
    got = run(spark, tmp_path, batches, "node string, ts timestamp", lambda s: stateful.timed_suspicions(s, 10.0, 5.0))
    seen = sorted((r.node, r.event, round(r.at - 1_700_000_000, 3)) for r in got)
    assert ("dead", "suspect", 11.0) in seen and not any(n == "dead" and e == "restore" for n, e, _ in seen)
    assert [(e, t) for n, e, t in seen if n == "live"] == [("restore", 100.0), ("restore", 150.0), ("suspect", 10.0), ("suspect", 118.0)]


def test_lamport_stamps_and_acceptor(spark, tmp_path):
    rng = random.Random(5)
    steps = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(40)])) for i in range(40)]
    schema = "node string, seq long, incoming long"
    got = run(spark, tmp_path, [steps[:20], steps[20:]], schema, stateful.lamport_stamps)
    want = events.lamport_times(spark.createDataFrame(steps, schema)).collect()
    assert {(r.seq, r.time) for r in got} == {(r.seq, r.time) for r in want}
    votes = [(rng.choice("ab"), i, rng.choice(["prepare", "accept"]), i // 3 + rng.randrange(5), str(i)) for i in range(40)]
    schema = "node string, seq long, kind string, ballot long, value string"
    got = run(spark, tmp_path, [votes[:15], votes[15:]], schema, stateful.acceptor)
    want = events.acceptor_replies(spark.createDataFrame(votes, schema)).collect()
    key = lambda r: (r.seq, r.reply, None if r.accepted_ballot is None or r.accepted_ballot != r.accepted_ballot else int(r.accepted_ballot), r.accepted_value)
    assert {key(r) for r in got} == {key(r) for r in want} and {r.reply for r in got} == {"promise", "accepted", "nack"}


def test_vector_release(spark, tmp_path):
    rng = random.Random(6)
    sent = {n: 0 for n in "abc"}
    rows = []
    for i in range(40):
        n, m = rng.sample("abc", 2)
        sent[n] += 1
        rows.append((n, {n: sent[n], m: rng.randrange(sent[m] + 1)}, str(i)))
    rng.shuffle(rows)
    log = [("l", i, n, c, m) for i, (n, c, m) in enumerate(rows)]
    got = run(spark, tmp_path, [log[:15], log[15:]], "log string, arrival long, node string, clock map<string,long>, msg string", stateful.vector_release)
    want = events.vector_release(spark.createDataFrame([x[1:4] for x in log], "arrival long, node string, clock map<string,long>")).collect()
    assert {(int(r.msg), r.released_at) for r in got} == {(int(log[r.arrival][4]), r.released_at) for r in want if r.released_at is not None}
    held = events.queue_sizes(events.vector_release(spark.createDataFrame([x[1:4] for x in log], "arrival long, node string, clock map<string,long>"))).orderBy("arrival").collect()
    assert held[-1].held == 0 and held[-1].most == max(r.held for r in held)
