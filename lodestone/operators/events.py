"""Clocks, ordering, duplicates, failures and agreement over event tables (STR-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.ranges import running


def clock_merge(a: Column, b: Column) -> Column:
    """Pointwise maximum of two vector clocks (maps); a missing entry is 0."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_leq(a: Column, b: Column) -> Column:
    """Whether a has happened by b."""
    return F.forall(F.map_entries(a), lambda e: e["value"] <= F.coalesce(b[e["key"]], F.lit(0)))


def clock_tick(a: Column, node: Column) -> Column:
    one = F.map_from_arrays(F.array(node), F.array(F.coalesce(a[node], F.lit(0)) + 1))
    return F.map_zip_with(a, one, lambda k, x, y: F.coalesce(y, x))


def lamport_violations(messages: DataFrame) -> DataFrame:
    """Messages (id, sent, received) whose receipt isn't stamped after their sending."""
    return messages.filter("received <= sent")


def lamport_times(steps: DataFrame) -> DataFrame:
    """steps (node, seq, incoming) with the node's time: one more than the greater of its last time and the incoming one.

    incoming is the time that a received message carries, null for a step of the node's own. With p the
    place among the node's steps, the time is p plus the most by which an incoming time was ahead of its place.
    """
    w = Window.partitionBy("node").orderBy("seq")
    place = steps.withColumn("_p", F.row_number().over(w))
    ahead = F.max(F.col("incoming") - F.col("_p") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return place.withColumn("time", F.col("_p") + F.greatest(F.coalesce(ahead, F.lit(0)), F.lit(0))).drop("_p")


def safe_release(log: DataFrame, nodes: list[str]) -> DataFrame:
    """(arrival, node, time, released_at): when each record of a log may be read in the order of time.

    A record is safe at the first arrival by which every declared node has been heard from with a
    time of at least its own. A record that is never safe has null. log is (arrival, node, time), arrivals
    are distinct.
    """
    heard = {f"_h{i}": ("max", F.when(F.col("node") == n, F.col("time"))) for i, n in enumerate(nodes)}
    seen = running(log.select("arrival", "node", "time"), [F.col("arrival")], heard)
    clocks = [F.coalesce(F.col(c), F.lit(0)) for c in heard]
    horizon = seen.select("arrival", (F.least(*clocks) if len(clocks) > 1 else clocks[0]).alias("safe"))
    # the horizon never falls, so the first arrival of each of its values is all that is needed
    steps = horizon.groupBy("safe").agg(F.min("arrival").alias("at"))
    both = log.select("arrival", "node", "time", F.lit(None).cast("long").alias("at"), F.col("time").alias("t"), F.lit(0).alias("kind")).unionByName(steps.select(F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("long").alias("time"), F.col("at").cast("long"), F.col("safe").alias("t"), F.lit(1).alias("kind")))
    first = running(both, [F.desc("t"), F.desc("kind"), F.asc("arrival")], {"first": ("min", F.col("at"))})
    return first.filter("kind = 0").select("arrival", "node", "time", F.when(F.col("first").isNotNull(), F.greatest("first", "arrival")).alias("released_at"))


def vector_release(log: DataFrame) -> DataFrame:
    """(arrival, node, released_at): when all that a record depends on has arrived; null if it never has.

    log is (arrival, node, clock), clock a map from node to count that has the record's own node; entries
    of 0 ask for nothing. A node's records are run through in ranges, so that a busy one isn't one task.
    """
    own = log.select(F.col("node").alias("k"), F.col("clock")[F.col("node")].alias("v"), "arrival")
    asks = log.select(F.explode("clock").alias("k", "v"), F.col("arrival").alias("asker")).filter("v > 0")
    both = own.withColumn("asker", F.lit(None).cast("long")).unionByName(asks.withColumn("arrival", F.lit(None).cast("long")))
    reached = running(both, [F.desc("v"), F.col("asker").isNotNull()], {"met": ("min", F.col("arrival"))}, within=F.col("k"))
    met = reached.filter("asker IS NOT NULL").groupBy(F.col("asker").alias("arrival")).agg(F.max("met").alias("met"), F.count_if(F.col("met").isNull()).alias("missing"))
    out = log.select("arrival", "node").join(met, "arrival", "left")
    return out.select("arrival", "node", F.when(F.coalesce("missing", F.lit(0)) == 0, F.greatest("met", "arrival")).alias("released_at"))


def queue_sizes(released: DataFrame) -> DataFrame:
    """(arrival, held, most): how many records (arrival, released_at) wait after each arrival, and the most so far."""
    moves = released.select(F.col("arrival").alias("at"), F.lit(1).alias("d")).unionByName(released.filter("released_at IS NOT NULL").select(F.col("released_at").alias("at"), F.lit(-1).alias("d")))
    per = moves.groupBy("at").agg(F.sum("d").alias("d"))
    held = running(per, [F.col("at")], {"held": ("sum", F.col("d"))})
    return running(held, [F.col("at")], {"most": ("max", F.col("held"))}).select(F.col("at").alias("arrival"), "held", "most")


def generated_messages(spark, nodes: list[str], n: int, sleep: float = 1.0, jitter: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, src, dst, sent, received): each node in turn sends to a peer at random, which gets it after a jitter."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    names = F.array(*[F.lit(x) for x in nodes])
    rows = spark.range(n).withColumn("_s", F.pmod("id", F.lit(len(nodes))).cast("int"))
    rows = rows.withColumn("_d", F.pmod(F.col("_s") + 1 + F.floor(u("peer") * (len(nodes) - 1)), F.lit(len(nodes))).cast("int"))
    sent = F.floor(F.col("id") / len(nodes)) * sleep + u("wait") * sleep
    return rows.select("id", names[F.col("_s")].alias("src"), names[F.col("_d")].alias("dst"), sent.alias("sent"), (sent + u("jitter") * jitter).alias("received"))


def newest_only(events: DataFrame, node: str, seq: str, arrival: str) -> DataFrame:
    """Rows whose sequence number exceeds all that came before from the same node."""
    before = F.max(seq).over(Window.partitionBy(node).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(seq) > F.col("_before"))).drop("_before")


def sequence_gaps(messages: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, missing): numbers that are followed by a gap, after duplicates are dropped."""
    ahead = running(messages.select(seq).distinct(), [F.desc(seq)], {"_next": ("min", F.col(seq))}, inclusive=False)
    return ahead.select(seq, (F.col("_next") - F.col(seq) - 1).alias("missing")).filter("missing > 0")


def multicast_delivery(copies: DataFrame) -> DataFrame:
    """(node, seq, delivered_at) of copies (node, seq, arrival): each number once, in order, from the node's first to before its first gap.

    Numbers below the awaited one are old and dropped, as when a new leader repeats the last message;
    later ones wait until those before them have come.
    """
    first = copies.groupBy("node", "seq").agg(F.min("arrival").alias("arrival"))
    w = Window.partitionBy("node").orderBy("seq")
    run = first.withColumns({"_p": F.row_number().over(w), "_least": F.min("seq").over(Window.partitionBy("node")), "delivered_at": F.max("arrival").over(w)})
    return run.filter("seq - _least = _p - 1").select("node", "seq", "delivered_at")


def node_status(events: DataFrame) -> DataFrame:
    """(node, last_seq, last_ts, n) of (node, seq, ts): what each node's tables hold now."""
    return events.groupBy("node").agg(F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def leaders(members: DataFrame) -> DataFrame:
    """(epoch, leader): of each epoch's living members (epoch, node, joined, alive) the one that joined first."""
    return members.filter("alive").groupBy("epoch").agg(F.min_by("node", F.struct("joined", "node")).alias("leader"))


def first_success(attempts: DataFrame) -> DataFrame:
    """(message, attempt, ts): the attempt at which each message was acknowledged first."""
    return attempts.filter("acked").groupBy("message").agg(F.min_by(F.struct("attempt", "ts"), F.struct("ts", "attempt")).alias("s")).select("message", "s.attempt", "s.ts")


def suspicions(beats: DataFrame, period: float, node: str = "node", ts: str = "ts", until: Column | None = None) -> DataFrame:
    """(node, suspected_at, restored_at): silences longer than ``period`` seconds after a heartbeat.

    A node that is silent up to ``until``, by default the last heartbeat of all, is suspected for good: restored_at
    is null.
    """
    ahead = F.lead(ts).over(Window.partitionBy(node).orderBy(ts))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    gap = beats.select(F.col(node).alias("node"), F.col(ts).cast("timestamp").alias("last"), ahead.cast("timestamp").alias("restored_at"))
    end = beats.agg(F.max(ts).cast("timestamp").alias("_end"))
    known = gap.crossJoin(F.broadcast(end)).withColumn("_end", F.col("_end") if until is None else until.cast("timestamp"))
    late = known.filter(seconds(F.coalesce("restored_at", "_end")) - seconds(F.col("last")) > period)
    return late.select("node", F.timestamp_micros(F.unix_micros("last") + int(period * 1e6)).alias("suspected_at"), "restored_at")


def broadcast_to(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every message for every node."""
    return messages.crossJoin(nodes)


def first_delivery(copies: DataFrame, node: str, message: str, ts: str) -> DataFrame:
    """One row a (node, message): the copy that came first; of equal times the least row."""
    others = [c for c in copies.columns if c not in (node, message, ts)]
    return copies.groupBy(node, message).agg(F.min(F.struct(ts, *others)).alias("s")).select(node, message, "s.*")


def register_read(replies: DataFrame, n: int) -> DataFrame:
    """(rid, value, ts, wr): for each read with replies of a majority of n, the value of the highest (ts, wr)."""
    got = replies.groupBy("rid").agg(F.count("*").alias("c"), F.max(F.struct("ts", "wr", "value")).alias("m"))
    return got.filter(F.col("c") > n / 2).select("rid", "m.value", "m.ts", "m.wr")


def chosen(accepts: DataFrame, n: int) -> DataFrame:
    """(instance, ballot, value): values that a majority of n acceptors took at one ballot; at most one value an instance."""
    votes = accepts.groupBy("instance", "ballot", "value").agg(F.count_distinct("node").alias("c")).filter(F.col("c") > n / 2)
    return votes.groupBy("instance").agg(F.min(F.struct("ballot", "value")).alias("s")).select("instance", "s.ballot", "s.value")


def promises(messages: DataFrame) -> DataFrame:
    """Prepare messages (node, seq, ballot) that a node promises: those above every earlier ballot of its."""
    return newest_only(messages, "node", "ballot", "seq")


def acceptor_replies(messages: DataFrame) -> DataFrame:
    """messages (node, seq, kind, ballot, value) in the order of seq with the acceptor's reply and what it had accepted before.

    A "prepare" above every ballot so far is a "promise", an "accept" of at least that is "accepted", all
    else a "nack". accepted_ballot and accepted_value are those of the last accepted message before.
    """
    past = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("ballot").over(past), F.lit(0))
    judged = messages.withColumn("_top", top).withColumn("reply", F.when((F.col("kind") == "prepare") & (F.col("ballot") > F.col("_top")), "promise").when((F.col("kind") == "accept") & (F.col("ballot") >= F.col("_top")), "accepted").otherwise("nack"))
    took = F.when(F.col("reply") == "accepted", F.struct("ballot", "value"))
    return judged.withColumn("_a", F.last(took, ignorenulls=True).over(past)).select("node", "seq", "kind", "ballot", "reply", F.col("_a.ballot").alias("accepted_ballot"), F.col("_a.value").alias("accepted_value"))


def proposals(replies: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(ballot, value): what each proposer may ask for after promises of a majority of n: the value of the highest accepted ballot among them, else its own.

    replies are those of ``acceptor_replies``; wanted is (ballot, value).
    """
    got = replies.filter("reply = 'promise'").groupBy("ballot").agg(F.count_distinct("node").alias("c"), F.max(F.struct("accepted_ballot", "accepted_value")).alias("m"))
    return got.filter(F.col("c") > n / 2).join(wanted, "ballot").select("ballot", F.when(F.col("m.accepted_ballot").isNotNull(), F.col("m.accepted_value")).otherwise(F.col("value")).alias("value"))


def retries(replies: DataFrame, step: int = 1) -> DataFrame:
    """(ballot, next_ballot): ballots that some acceptor refused, with the one that their proposer tries next."""
    return replies.filter("reply = 'nack'").select("ballot").distinct().select("ballot", (F.col("ballot") + step).alias("next_ballot"))


def decided_length(acks: DataFrame, n: int) -> DataFrame:
    """(decided): the longest prefix that a majority of n nodes has acknowledged, from (node, acked)."""
    high = acks.groupBy("node").agg(F.max("acked").alias("acked"))
    place = high.withColumn("place", F.row_number().over(Window.orderBy(F.desc("acked"), "node")))
    return place.filter(F.col("place") == n // 2 + 1).agg(F.coalesce(F.max("acked"), F.lit(0)).alias("decided"))


def adopted_suffix(replies: DataFrame) -> DataFrame:
    """(suffix): of the promises (na, suffix) the one of the highest ballot, then the longest."""
    return replies.agg(F.max_by("suffix", F.struct("na", F.size("suffix"))).alias("suffix"))


def colour_states(deliveries: DataFrame, until: Column | None = None) -> DataFrame:
    """(node, r, g, b): each node's colour after its deliveries (node, seq, n) in order of seq.

    A delivery n turns {R, G, B} into {G, B, (R + n) mod 256}; ``until`` bounds seq, for a joiner's snapshot.
    """
    kept = deliveries if until is None else deliveries.filter(F.col("seq") <= until)
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("b"))
    step = lambda s, x: F.struct(s["g"].alias("r"), s["b"].alias("g"), F.pmod(s["r"] + x["n"].cast("long"), F.lit(256)).alias("b"))
    return kept.groupBy("node").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("seq", "n"))), zero, step).alias("s")).select("node", "s.r", "s.g", "s.b")


def effective_times(messages: DataFrame, controls: DataFrame) -> DataFrame:
    """messages (node, ts, ...) with the time at which each is applied: within freeze .. go, the time of the next go.

    controls is (node, ts, ctrl) with ctrl "freeze" or "go"; null where a freeze is never lifted.
    """
    both = messages.withColumn("ctrl", F.lit(None).cast("string")).unionByName(controls, allowMissingColumns=True)
    past = Window.partitionBy("node").orderBy("ts", F.col("ctrl").isNull())
    state = F.last("ctrl", ignorenulls=True).over(past)
    go = F.min(F.when(F.col("ctrl") == "go", F.col("ts"))).over(past.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumns({"_state": state, "_go": go}).filter("ctrl IS NULL").withColumn("effective", F.when(F.col("_state") == "freeze", F.col("_go")).otherwise(F.col("ts"))).drop("ctrl", "_state", "_go")


def alive(joined: DataFrame, down: DataFrame) -> DataFrame:
    """Rows of joined (node, ts) that no later DOWN of the node follows."""
    last = down.groupBy("node").agg(F.max("ts").alias("_down"))
    return joined.join(last, "node", "left").filter("_down IS NULL OR _down < ts").drop("_down")


def stamped(messages: DataFrame, node: str, ts: str) -> DataFrame:
    """messages with their number, from 0, among their node's."""
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy(node).orderBy(ts)) - 1)
