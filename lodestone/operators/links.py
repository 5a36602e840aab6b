"""PageRank, its Monte-Carlo estimates, and hubs and authorities over (src, dst) edges (LA-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.draws import uniform
from lodestone.plans.ranges import numbered
from lodestone.plans.storage import release, stored


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id) of every end point."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int = 1000, nodes: DataFrame | None = None, start: str = "uniform") -> DataFrame:
    """(id, rank) by power iteration; the mass of nodes without links is spread evenly.

    start puts all mass on the least id ("first") or spreads it ("uniform"). With a tolerance of 0
    exactly ``rounds`` rounds are made.
    """
    links = stored(edges.select("src", "dst").distinct())
    ids = nodes_of(links) if nodes is None else nodes.select("id").distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    node = stored(ids.join(degree.withColumnRenamed("src", "id"), "id", "left"))
    n, first = node.agg(F.count("*"), F.min("id")).first()
    if not n:
        return node.select("id", F.lit(0.0).alias("rank"))
    begin = F.lit(1.0 / n) if start == "uniform" else (F.col("id") == first).cast("double")
    rank, last = node.select("id", "degree", begin.alias("rank")), None
    for _ in range(rounds):
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        flow = links.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("in"))
        new = rank.withColumnRenamed("rank", "old").join(flow, "id", "left").crossJoin(F.broadcast(dangling))
        value = damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n) + (1 - damping) / n
        new = new.select("id", "degree", value.alias("rank"), "old")
        new = stored(new)  # a round reads the last one three times
        release(last)
        rank, last = new.drop("old"), new
        if tolerance > 0 and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] <= tolerance:
            break
    return rank.select("id", "rank")


def random_walks(edges: DataFrame, walks: int, start: str = "random", count: str = "end", damping: float = 0.85, seed: int = 1, block: int = 8) -> DataFrame:
    """(id, rank) estimated by walks that go on with probability ``damping``, until every one has ended.

    start: each walk begins at a random node, or they take the nodes in turn ("cyclic"). count: where
    a walk ends ("end", dangling nodes jump anywhere) or every visit ("path", a dangling node ends it).
    ``block`` steps make one job; a walk that has ended waits at its node until the job is done.
    """
    links = stored(edges.select("src", "dst").distinct())
    node = stored(numbered(nodes_of(links), "no", F.col("id")))
    n = node.count()
    if not n:
        return node.select("id", F.lit(0.0).alias("rank"))
    to = links.join(node.select(F.col("id").alias("src"), F.col("no").alias("from")), "src").join(node.select(F.col("id").alias("dst"), "no"), "dst")
    lists = to.groupBy(F.col("from").alias("no")).agg(F.sort_array(F.collect_list("no")).alias("out"))
    out = stored(node.select("no").join(lists, "no", "left"))
    walk = node.sparkSession.range(walks).withColumnRenamed("id", "walk")
    no = F.pmod("walk", F.lit(n)) if start == "cyclic" else F.floor(uniform(seed, "start", F.col("walk")) * n)
    at, counts, i, last = walk.select("walk", no.cast("long").alias("no")), None, 0, None
    fresh = count == "path"
    while True:
        rows = at.withColumns({"alive": F.lit(True), "path": F.array("no") if fresh else F.array().cast("array<bigint>")})
        for i in range(i, i + block):
            rows = rows.join(out, "no")
            size = F.coalesce(F.size("out"), F.lit(0))
            go = F.col("alive") & (uniform(seed, "go", i, F.col("walk")) < damping)
            if count == "path":
                go = go & (size > 0)
            there = F.col("out")[F.floor(uniform(seed, "to", i, F.col("walk")) * size).cast("int")]
            there = F.when(size > 0, there).otherwise(F.floor(uniform(seed, "jump", i, F.col("walk")) * n).cast("long"))
            rows = rows.select("walk", F.when(go, there).otherwise(F.col("no")).alias("no"), go.alias("alive"), F.when(go, F.array_append("path", there)).otherwise(F.col("path")).alias("path"))
        i += 1
        rows, fresh = stored(rows), False
        seen = rows.select(F.explode("path").alias("no")) if count == "path" else rows.filter("NOT alive").select("no")
        part = seen.groupBy("no").agg(F.count("*").alias("n"))
        before, counts = counts, stored(part if counts is None else part.unionByName(counts).groupBy("no").agg(F.sum("n").alias("n")))
        release(before, last)
        at, last = rows.filter("alive").select("walk", "no"), rows
        if at.isEmpty():
            break
    total = counts.agg(F.sum("n").alias("total"))
    return node.join(counts, "no", "left").crossJoin(F.broadcast(total)).select("id", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rank"))


def walks_until_stable(edges: DataFrame, batch: int = 10_000, checks: int = 6, k: int = 30, seed: int = 1, most: int = 1000) -> DataFrame:
    """Path estimates over ever more walks, until the order of the k best holds in ``checks`` successive checks; an error if ``most`` batches don't suffice."""
    same, before, total = 0, None, None
    for i in range(most):
        one = random_walks(edges, batch, "random", "path", seed=seed + i)
        last, total = total, stored(one if total is None else total.unionByName(one).groupBy("id").agg(F.sum("rank").alias("rank")))
        release(last)
        order = [r["id"] for r in total.orderBy(F.desc("rank"), "id").limit(k).collect()]
        same = same + 1 if order == before else 0
        before = order
        if same >= checks:
            return total.select("id", (F.col("rank") / (i + 1)).alias("rank"))
    raise RuntimeError(f"the order of the {k} best didn't settle in {most} batches")


def goodness(ranks: DataFrame, other: DataFrame, k: int = 30) -> DataFrame:
    """(top_squared, l1): squared difference over the k best of ``ranks``, and the L1 difference of all."""
    both = ranks.select("id", F.col("rank").alias("a")).join(other.select("id", F.col("rank").alias("b")), "id", "full_outer").fillna(0.0, ["a", "b"])
    best = ranks.orderBy(F.desc("rank"), "id").limit(k).select("id", F.lit(True).alias("best"))
    marked = both.join(best, "id", "left")
    return marked.agg(F.sum(F.when(F.col("best"), F.pow(F.col("a") - F.col("b"), 2))).alias("top_squared"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("l1"))


def base_set(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id): the root set with everything that links to it or that it links to."""
    ids = root.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return ids.union(out).union(back).distinct()


def hits(edges: DataFrame, root: DataFrame | None = None, tolerance: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(id, hub, authority), each of Euclidean length 1, over all nodes or the base set of a root set."""
    links = edges.select("src", "dst").distinct()
    if root is not None:
        base = stored(base_set(links, root))
        links = links.join(base.withColumnRenamed("id", "src"), "src", "left_semi").join(base.withColumnRenamed("id", "dst"), "dst", "left_semi")
        ids = base
    links = stored(links)
    ids = nodes_of(links) if root is None else ids
    score, last = ids.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), None
    unit = lambda c: F.when(F.col("length") > 0, F.col(c) / F.col("length")).otherwise(0.0)
    for _ in range(rounds):
        taken = links.join(score.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("in"))
        given = links.join(score.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("out"))
        raw = stored(score.join(taken, "id", "left").join(given, "id", "left").fillna(0.0, ["in", "out"]))
        size = raw.agg(F.sqrt(F.sum(F.col("in") * F.col("in"))).alias("l_in"), F.sqrt(F.sum(F.col("out") * F.col("out"))).alias("l_out"))
        new = raw.crossJoin(F.broadcast(size)).select("id", F.when(F.col("l_out") > 0, F.col("out") / F.col("l_out")).otherwise(0.0).alias("hub"), F.when(F.col("l_in") > 0, F.col("in") / F.col("l_in")).otherwise(0.0).alias("authority"), (F.col("hub")).alias("old_hub"), F.col("authority").alias("old_authority"))
        new = stored(new)
        release(raw, last)
        score, last = new.select("id", "hub", "authority"), new
        if tolerance > 0:
            change = new.agg(F.sum(F.abs(F.col("hub") - F.col("old_hub")) + F.abs(F.col("authority") - F.col("old_authority")))).first()[0]
            if change is None or change < tolerance:
                break
    return score


def hits_ranking(root: DataFrame, edges: DataFrame, key: str = "doc_id", tolerance: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(doc_id, score): hub plus authority of each document of the root set, 0 where it has no links."""
    found = hits(edges, root.select(F.col(key).alias("id")), tolerance, rounds)
    return root.join(found.withColumnRenamed("id", key), key, "left").select(key, (F.coalesce("hub", F.lit(0.0)) + F.coalesce("authority", F.lit(0.0))).alias("score"))


def best(scores: DataFrame, column: str, k: int = 30) -> DataFrame:
    return scores.orderBy(F.desc(column), "id").limit(k).select("id", column)
