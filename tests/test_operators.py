"""Small hand-made cases: empty inputs, ties, wrap-around, dangling nodes, thresholds."""

import datetime as dt
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import agents, events, graphs, index, itemsets, learn, links, routing, search, similar
from lodestone.plans import ranges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ix(spark):
    docs = [(0, "the cat sat on the mat"), (1, "The Dog sat"), (2, ""), (3, None), (4, "cat cat dog")]
    return search.Index.of(spark.createDataFrame(docs, "doc_id long, text string"))


def test_search(ix):
    assert rows(ix.search("cat dog", "and")) == [(4,)] and rows(ix.search("sat", "and")) == [(0,), (1,)]
    assert rows(ix.search("cat cat", "phrase")) == [(4, 1)] and rows(ix.search("the mat", "phrase")) == [(0, 5)]
    assert rows(ix.search("absent", "and")) == [] and rows(ix.search("absent cat", "phrase")) == []
    assert rows(ix.search("*", "and")) == [(0,), (1,), (4,)] and rows(ix.search("*at d*", "and")) == [(1,), (4,)]
    assert rows(ix.search("c*t", "and")) == rows(ix.search("cat", "and")) == [(0,), (4,)]
    assert [r.doc_id for r in search.top(ix.search("cat")).collect()] == [4, 0]
    assert ix.search("cat", norm="euclid").count() == 2
    ranks = ix.docs.select("doc_id", F.lit(0.5).alias("rank"))
    assert {r.doc_id: r.score for r in ix.search("cat dog", ranking="pagerank", pagerank=ranks).collect()} == {0: 0.5, 1: 0.5, 4: 1.0}
    edges = ix.docs.sparkSession.createDataFrame([(0, 4), (1, 4)], "src long, dst long")
    best = ix.search("cat dog", ranking="hits", links=edges).orderBy(F.desc("score")).first()
    assert best.doc_id == 4


def test_spelling_and_feedback(ix, spark):
    assert [r.term for r in search.spelling(ix, "catt").collect()] == ["cat"]
    got = {r.term: r.weight for r in search.feedback(ix, {"dog": 1.0}, spark.createDataFrame([(4,)], "doc_id long")).collect()}
    assert got == pytest.approx({"dog": 0.2 + 0.8, "cat": 1.6})


def test_index_merge(ix):
    t = ix.postings.select("term", "doc_id", F.explode("positions").alias("pos"))
    merged = index.merge_postings(index.postings(t.filter("doc_id < 2")), index.postings(t.filter("doc_id >= 1")))
    whole = index.postings(t)
    assert rows(merged.select("term", "doc_id", "tf", "positions")) == rows(whole)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=5), st.text("abc", max_size=5)), min_size=30, max_size=60))
def test_indel_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(tx.indel_at_most_two(F.col("a"), F.col("b")).alias("near"), tx.indel_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.near == (r.d <= 2) for r in got)


def test_text(spark):
    df = spark.createDataFrame([("See a.b@c.de, 12:30 and don't!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.pattern_tokens(F.col("t"))).collect()] == [["See", "a.b@c.de", "12:30", "and", "don't"], None, []]
    odd = spark.createDataFrame([("a b: c, d? e;f=g <h>",), ("it's 24/7 at 10.0.0.1, e.g. $100 x-y a.doc",), ("get 'em +46-22 1999-12-31",)], "t string")
    assert [r[0] for r in odd.select(tx.printable_tokens(F.col("t"), True)).collect()][0] == list("ab:c,d?e;f=g<h>")
    assert [r[0] for r in odd.select(tx.pattern_tokens(F.col("t"))).collect()][1:] == [["it's", "24/7", "at", "10.0.0.1", "e.g.", "$100", "x-y", "a.doc"], ["get", "'em", "+46-22", "1999-12-31"]]
    assert odd.select(tx.plain_letters(F.lit("øæłđßħıŁ×÷Þ"))).first()[0] == "oeldShiL*/T"
    crc = odd.select(tx.shingles(F.lit("Abcd"), 3)).first()[0]
    assert crc == [zlib.crc32(b"abc"), zlib.crc32(b"bcd")]
    one = lambda c: df.limit(1).select(c).first()[0]
    assert one(tx.kgrams(F.lit("ab"), 2)) == ["^a", "ab", "b$"] and one(tx.kgrams(F.lit(""), 4)) == []
    assert one(tx.shingles(F.lit("aBc"), 2, hashed=False)) == ["ab", "bc"] and one(tx.shingles(F.lit("a"), 2)) == []
    assert one(tx.shingles(F.lit("abc"), 2, hashed=False, include_last=False)) == ["ab"]
    assert one(tx.plain_letters(F.lit("éÇž"))) == "eCz" and one(tx.content_type(F.lit("/a.HTML?x"))) == "text/html"


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgh"), (3, "zyxwvuts"), (4, ""), (5, None)], "doc_id long, text string")
    assert rows(similar.jaccard_pairs(similar.shingle_sets(docs, 3))) == [(1, 2, 1.0)]
    assert rows(similar.lsh_pairs(docs, 3)) == [(1, 2, 1.0)]


def test_itemsets(spark):
    pairs = spark.createDataFrame([(b, i) for b, items in enumerate(([1, 2, 3], [1, 2], [1, 2], [3], [4, 4])) for i in items], "basket long, item long")
    got = {tuple(r.itemset): r.freq for r in itemsets.frequent_itemsets(pairs, 0.4).collect()}
    assert got == {(1,): 3, (2,): 3, (1, 2): 3}  # two of five is not more than 0.4
    rule = {(tuple(r.lhs), r.rhs): r.confidence for r in itemsets.rules(pairs, itemsets.frequent_itemsets(pairs, 0.4), 0.3).collect()}
    assert rule[((1,), 2)] == 1.0 and rule[((1, 2), 3)] == pytest.approx(1 / 3)


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (2, 4), (3, 4)], "src long, dst long")
    rank = {r.id: r.rank for r in links.pagerank(edges, tolerance=1e-9).collect()}
    want = dict.fromkeys(range(5), 0.2)
    out = {0: [1, 2, 3], 1: [3], 2: [3, 4], 3: [4], 4: []}
    for _ in range(200):
        lost = sum(want[i] for i in out if not out[i])
        want = {i: 0.03 + 0.85 * (lost / 5 + sum(want[j] / len(out[j]) for j in out if i in out[j])) for i in out}
    assert rank == pytest.approx(want, abs=1e-6) and sum(rank.values()) == pytest.approx(1)
    stable = {r.id: r.rank for r in links.walks_until_stable(edges, 4000, 1, 2).collect()}
    assert stable == pytest.approx(stable) and max(stable, key=stable.get) == 4
    with pytest.raises(RuntimeError, match="settle"):
        links.walks_until_stable(edges, 5, 6, 5, most=1)
    for start, count in (("random", "end"), ("cyclic", "end"), ("cyclic", "path"), ("random", "path")):
        got = {r.id: r.rank for r in links.random_walks(edges, 3000, start, count).collect()}
        assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == 4
    assert links.goodness(links.pagerank(edges), links.pagerank(edges)).first().l1 < 1e-9


def test_graphs(spark):
    two = [(a, b) for k in (0, 10) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(0, 10)]
    edges = spark.createDataFrame(two, "src long, dst long")
    got = graphs.triangles(edges).first()
    assert got.triangles == 40
    part = {r.id: r.cluster for r in graphs.spectral_clusters(edges, 2, normalize="row").collect()}
    assert len({part[i] for i in range(6)}) == 1 and len(set(part.values())) == 2
    colored, report = graphs.partition(edges, 2, rounds=4, seed=3, t0=0.5)
    cuts = [r.edge_cut for r in report.orderBy("round").collect()]
    assert sorted(r.n for r in graphs.color_counts(colored).collect()) == [6, 6] and cuts[-1] <= cuts[0]
    assert report.columns == ["round", "edge_cut", "swaps", "migrations"] and report.orderBy(F.desc("round")).first().migrations <= 12
    grid = spark.createDataFrame([(0.9, 5e-6, 0.045, 1.0, 300, s) for s in range(8)], "t0 double, least double, delta double, alpha double, rounds int, seed int")
    assert min(r.edge_cut for r in graphs.sweep(edges, grid, 2).collect()) == 1
    stream = edges.withColumn("t", F.expr("row_number() over (order by src, dst)").cast("long"))
    assert graphs.edge_reservoir(stream, 50).count() == 50


def test_knn_and_reports(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "a"), (3, [5.0], "b"), (4, [5.1], "b"), (5, [0.05], "b")], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.prediction for r in learn.knn(df, df, 3).collect()}
    assert got[5] == "a" and got[1] == "b"  # 5, 2 and 3 are nearest to 1
    assert {r.label: r.recall for r in learn.report(df.join(learn.knn(df, df, 1), "vec_id")).collect()}["b"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="range"):
        learn.require(learn.random_flowers(spark, 50), {"petal_width": (0.0, 0.1)})
    assert learn.require(learn.random_flowers(spark, 50), learn.IRIS_BOUNDS).count() == 50


def _released(log, nodes):
    clock, queue, out = {}, [], {}
    for arrival, node, time in log:
        clock[node] = max(clock.get(node, 0), time)
        queue.append((arrival, node, time))
        safe = min(clock.get(n, 0) for n in nodes)
        out |= {q[0]: arrival for q in queue if q[2] <= safe and q[0] not in out}
    return out


def test_safe_release(spark):
    rng = random.Random(1)
    log = [(i, rng.choice("abc"), max(1, i // 2 + rng.randrange(5))) for i in range(80)]
    got = {r.arrival: r.released_at for r in events.safe_release(spark.createDataFrame(log, "arrival long, node string, time long"), ["a", "b", "c"]).collect()}
    want = _released(log, "abc")
    assert got == {i: want.get(i) for i, _, _ in log}


def test_agreement(spark):
    votes = spark.createDataFrame([(1, 1, "x", n) for n in "ab"] + [(1, 2, "y", n) for n in "abc"], "instance int, ballot int, value string, node string")
    assert rows(events.chosen(votes, 5)) == [(1, 2, "y")]
    clocks = spark.createDataFrame([({"a": 1, "b": 2}, {"a": 3})], "x map<string,int>, y map<string,int>")
    assert clocks.select(events.clock_merge(F.col("x"), F.col("y"))).first()[0] == {"a": 3, "b": 2}
    assert clocks.select(events.clock_leq(F.col("y"), F.col("x")), events.clock_leq(F.col("x"), F.col("x"))).first()[:] == (False, True)
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    msgs = spark.createDataFrame([("n", at(1)), ("n", at(3)), ("n", at(9))], "node string, ts timestamp")
    ctrl = spark.createDataFrame([("n", at(2), "freeze"), ("n", at(5), "go")], "node string, ts timestamp, ctrl string")
    assert [r.effective.second for r in events.effective_times(msgs, ctrl).orderBy("ts").collect()] == [1, 5, 9]


def test_ring(spark):
    nodes = spark.createDataFrame([(10,), (3_000_000,), (20,)], "node long")
    keys = spark.createDataFrame([(10,), (11,), (25,), (3_000_001,), (0,)], "key long")
    assert {r.key: r.owner for r in routing.owners(nodes, keys).collect()} == {10: 10, 11: 20, 25: 3_000_000, 3_000_001: 10, 0: 10}
    ring = {r.node: (r.predecessor, r.successor) for r in routing.ring(nodes).collect()}
    assert ring[10] == (3_000_000, 20)
    one = lambda k, a, b: keys.limit(1).select(routing.between(F.lit(k), F.lit(a), F.lit(b))).first()[0]
    assert one(5, 5, 5) and one(1, 9, 2) and not one(5, 9, 2) and one(2, 1, 2) and not one(1, 1, 2)


def test_http(spark):
    raw = spark.createDataFrame([("GET /foo HTTP/1.1\r\nHost: x\r\nA: b\r\n\r\nbody",), ("broken",)], "raw string")
    good, bad = routing.parse_http(raw).collect()
    assert (good.method, good.uri, good.version, good.headers, good.body) == ("GET", "/foo", "1.1", ["Host: x", "A: b"], "body")
    assert bad.method is None


def test_auctions(spark):
    offers = spark.createDataFrame([(1, "a", 50.0, 2), (1, "b", 50.0, 1), (1, "c", 40.0, 3), (2, "d", 5.0, 1)], "auction long, bidder string, bid double, place long")
    assert rows(agents.first_price(offers)) == [(1, "b", 50.0), (2, "d", 5.0)]
    assert rows(agents.second_price(offers)) == [(1, "b", 50.0), (2, "d", 5.0)]
    held = spark.createDataFrame([(1, 75.0, 10.0), (2, 75.0, 10.0), (3, 75.0, 10.0)], "auction long, start double, least double")
    got = {r.auction: (r.winner, r.price) for r in agents.dutch_auction(held, offers.withColumnRenamed("bid", "max_price")).collect()}
    assert got == {1: ("b", 45.0), 2: (None, None), 3: (None, None)}
    assert agents.queens(spark, 6).count() == 4


def _small_world(n=250, edges=1033, seed=1):
    rng = random.Random(seed)
    found = {(min(i, y), max(i, y)) for i in range(n) for j in range(1, 5) if (y := (i + j) % n if rng.random() >= 0.05 else rng.randrange(n)) != i}
    while len(found) < edges:
        x, y = rng.sample(range(n), 2)
        found.add((min(x, y), max(x, y)))
    return sorted(found)


def test_annealing_cuts_a_small_world(spark):
    edges = spark.createDataFrame(_small_world(), "src long, dst long")
    grid = spark.createDataFrame([(0.92, 2.5e-5, 0.005, 1.0, 1000, s) for s in range(12)], "t0 double, least double, delta double, alpha double, rounds int, seed int")
    got = graphs.sweep(edges, grid).collect()
    assert min(r.edge_cut / r.first_cut for r in got) <= 0.18 and all(r.edge_cut / r.first_cut < 0.35 for r in got)


def test_nearest_in_rings_of_cells(spark):
    rng = random.Random(4)
    spots = [(i, rng.random() * 10, rng.random() * 10) for i in range(40)] + [(40, 500.0, 500.0)]
    at = [(i, rng.random() * 20 - 5, rng.random() * 20 - 5) for i in range(60)] + [(60, 400.0, 390.0), (61, 7.0, 7.0)]
    got = {r.l_id: r.r_id for r in agents.nearest(spark.createDataFrame(at, "id long, x double, y double"), spark.createDataFrame(spots, "id long, x double, y double")).collect()}
    assert got == {i: min(spots, key=lambda s: ((x - s[1]) ** 2 + (y - s[2]) ** 2, s[0]))[0] for i, x, y in at}


def test_running_values(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, rng.randrange(100)])) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "at long, v long")
    got = {r.at: (r.m, r.s, r.b) for r in ranges.running(ranges.running(df, [F.col("at")], {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}), [F.desc("at")], {"b": ("min", F.col("v"))}, inclusive=False).collect()}
    for at, _ in data:
        own = [v for a, v in data if a <= at and v is not None]
        after = [v for a, v in data if a > at and v is not None]
        assert got[at] == (max(own, default=None), sum(own), min(after, default=None))
    assert [r.no for r in ranges.numbered(df, "no", F.col("at")).orderBy("at").collect()] == list(range(300))
    assert ranges.numbered(df.limit(0), "no", F.col("at")).count() == 0


def test_model_and_features(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "a"), (3, [5.0], "b")], "vec_id long, embedding array<double>, label string")
    learn.save_model(df, str(tmp_path / "m"))
    model = learn.load_model(spark, str(tmp_path / "m"))
    assert learn.predict_one(model, spark, 4.0) == "b" and learn.predict_one(model, spark, 0.2) == "a"
    for v in (1.0, 2.0):
        learn.insert_features(str(tmp_path / "g"), spark.createDataFrame([(1, v)], "k long, v double"), ["k"])
    assert rows(learn.read_features(spark, str(tmp_path / "g"), ["k"])) == [(1, 2.0)]


def test_suspected_for_good_and_timed_search(spark, ix):
    beats = spark.createDataFrame([("dead", 0), ("dead", 1), ("live", 0), ("live", 100)], "node string, s long").select("node", F.timestamp_seconds("s").alias("ts"))
    got = {(r.node, r.suspected_at.second, r.restored_at is None) for r in events.suspicions(beats, 10.0).collect()}
    assert got == {("dead", 11, True), ("live", 10, False)}
    assert search.timed_search(ix, "cat")["rows"] == 2
    found, hints = search.search_or_suggest(ix, "catt")
    assert found.isEmpty() and [r.term for r in hints.collect()] == ["cat"] and search.search_or_suggest(ix, "cat")[1] is None
