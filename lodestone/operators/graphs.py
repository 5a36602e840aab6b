"""Triangles, spectral clustering and balanced partitioning (TRI-*, SPC-*, GP-*)."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.draws import uniform
from lodestone.plans.ranges import numbered
from lodestone.plans.storage import release, stored


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, each edge once, without loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of an undirected (a, b) table."""
    return edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count("*").alias("degree"))


def wedge_count(edges: DataFrame) -> DataFrame:
    """(wedges): pairs of edges that share an end, of an undirected table."""
    return degrees(edges).agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) DIV 2")), F.lit(0)).alias("wedges"))


def directed_wedge_count(edges: DataFrame) -> DataFrame:
    """(wedges): pairs of an edge into a node and one out of it."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("into"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    return into.join(out, "id").agg(F.coalesce(F.sum(F.col("into") * F.col("out")), F.lit(0)).alias("wedges"))


#: Edges that one step of a triangle count looks up, and pairs of edges that it holds at a time.
TRIANGLE_BLOCK, TRIANGLE_STEP = 2_000_000, 1 << 21


def _sent(bounds: np.ndarray):
    """Rows (kind, a, vs) as (block, kind, a, vs): of kind 0 to the block of a, of kind 1 to each block that their sorted vs have nodes in, from the first of those on."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                kind, own, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
                ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
                ends = ends - ends[0]
                row = np.repeat(np.arange(len(own)), np.diff(ends))
                block = np.searchsorted(bounds, np.where(kind[row] == 0, own[row], flat), "right")
                begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])][: len(row)])
                size = ends[row[begin] + 1] - begin
                begin, size = (x[(size > 1) | (kind[row[begin]] == 0)] for x in (begin, size))
                row, block, stop = row[begin], block[begin], np.cumsum(size)
                for first in range(0, len(begin), 1024):
                    part = slice(first, first + 1024)
                    n, off = size[part], stop[part] - size[part]
                    places = np.repeat(begin[part] - off, n) + np.arange(off[0], off[0] + n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(block[part].astype(np.int32)), pa.array(kind[row[part]]), pa.array(own[row[part]]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[places]))], ["block", "kind", "a", "vs"])

    return run


class _Edges:
    """A set of edges (a, b), asked by pairs of nodes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = np.unique(a), np.unique(b)
        self.keys = np.sort(np.searchsorted(self.a, a) * len(self.b) + np.searchsorted(self.b, b))
        self.bits = np.uint64(64 - 5 - max(len(a), 1).bit_length())
        self.near = np.zeros(1 << (64 - int(self.bits)), bool)  # most pairs are no edge, and are told so here
        self.near[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def closed(self, flat: np.ndarray, ends: np.ndarray) -> int:
        """How many pairs of a node and a later one of its list are edges."""
        x, y = (np.minimum(np.searchsorted(names, flat), len(names) - 1) for names in (self.a, self.b))
        last = np.repeat(ends[1:], np.diff(ends))
        first = np.flatnonzero((self.a[x] == flat) & (last - np.arange(len(flat)) > 1))
        y = np.where(self.b[y] == flat, y, -1)
        n, total = last[first] - first - 1, 0
        sums, at = np.cumsum(n), 0
        while at < len(first):
            before = sums[at] - n[at]
            to = max(at + 1, int(np.searchsorted(sums, before + TRIANGLE_STEP, "right")))
            own, more = first[at:to], n[at:to]
            other = y[np.repeat(own + 1 - (sums[at:to] - more - before), more) + np.arange(more.sum())]
            keys = (np.repeat(x[own], more) * len(self.b) + other)[other >= 0]
            keys = keys[self.near[self._slot(keys)]]
            total += int((self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys).sum())
            at = to
        return total


def _closed(batches):
    """(n): pairs of nodes in the lists of each block that its edges close; a block's edges come before its lists."""
    at, held, edges, total = None, [], None, 0
    for b in batches:
        block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), True]) if b.num_rows else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if block[i] != at:
                at, held, edges = block[i], [], None
            lists = b.column(3).slice(i, j - i)
            ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
            ends = ends - ends[0]
            if kind[i] == 0:
                held.append((np.repeat(b.column(2).to_numpy()[i:j], np.diff(ends)), flat))
                continue
            if edges is None and held:
                edges, held = _Edges(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            total += edges.closed(flat, ends) if edges is not None else 0
    yield pa.RecordBatch.from_arrays([pa.array([total])], ["n"])


def triangles(edges: DataFrame) -> DataFrame:
    """(triangles, wedges, transitivity) exactly, of nodes that are whole numbers; edges point to the node of larger degree, so that no node has many.

    Pairs of edges are neither shuffled nor stored. The edges are cut into blocks by their lesser node; each
    node's list of those that it points to is sent to the blocks that it has nodes in, and a block's task
    looks up the pairs of each list. What is shuffled is the lists, once for each such block.
    """
    spark = edges.sparkSession
    pairs = stored(undirected(edges).select(F.col("a").cast("long"), F.col("b").cast("long")))
    degree = degrees(pairs)
    sized = pairs.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = sized.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    blocks = max(-(-pairs.count() // TRIANGLE_BLOCK), min(2 * spark.sparkContext.defaultParallelism, 64))
    bounds = np.unique(np.array(pairs.approxQuantile("a", [i / blocks for i in range(1, blocks)], 1 / (8 * blocks)), np.int64))
    lists = out.groupBy(F.col("u").alias("a")).agg(F.sort_array(F.collect_list("v")).alias("vs")).filter(F.size("vs") > 1)
    rows = pairs.groupBy("a").agg(F.collect_list("b").alias("vs")).select(F.lit(0).alias("kind"), "a", "vs").unionByName(lists.select(F.lit(1).alias("kind"), "a", "vs"))
    sent = rows.mapInArrow(_sent(bounds), "block int, kind int, a long, vs array<long>").repartition(blocks, "block").sortWithinPartitions("block", "kind")
    closed = sent.mapInArrow(_closed, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))
    return closed.crossJoin(wedge_count(pairs)).select("triangles", "wedges", F.try_divide(3 * F.col("triangles"), F.col("wedges")).alias("transitivity"))


def edge_reservoir(stream: DataFrame, slots: int, seed: int = 1) -> DataFrame:
    """(slot, t, src, dst): the edge that each slot holds after the stream (t, src, dst), t from 1.

    Edge t replaces a slot's with probability 1/t, slot by slot. Read from the end, the slot's edge is
    the first of its stream that is accepted: t_last = ceil(u * n) for uniform u, which draws from the
    same distribution without a pass for each slot.
    """
    n = stream.agg(F.max("t").alias("n"))
    u = 1 - uniform(seed, F.col("slot"))
    drawn = stream.sparkSession.range(slots).withColumnRenamed("id", "slot").crossJoin(F.broadcast(n)).select("slot", F.least(F.ceil(u * F.col("n")), F.col("n")).alias("t"))
    return drawn.join(stream, "t").select("slot", "t", "src", "dst")


def new_wedges(reservoir: DataFrame, edge: DataFrame) -> DataFrame:
    """(centre, a, b): wedges, a < b, that one edge (src, dst) makes with the edges (src, dst) of a reservoir, each once."""
    held = undirected(reservoir)
    new = edge.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).filter("p <> q").distinct()
    both = held.crossJoin(F.broadcast(new)).filter("NOT (a = p AND b = q)")
    one = lambda centre, x, y: both.filter(f"{centre[0]} = {centre[1]}").select(F.col(centre[0]).alias("centre"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return one(("a", "p"), "b", "q").unionByName(one(("a", "q"), "b", "p")).unionByName(one(("b", "p"), "a", "q")).unionByName(one(("b", "q"), "a", "p")).distinct()


def closed_wedges(wedges: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """Wedges (a, b, ...) that an edge closes: one between a and b, or directed one from b to a."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    found = back if directed else back.unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return wedges.join(found.distinct(), ["a", "b"], "left_semi")


def triangle_estimate(p: Column, t: Column, slots: Column, wedges: Column) -> tuple[Column, Column]:
    """(transitivity, triangles) from the share p of closed wedge slots after t edges, and the reservoir's number of wedges."""
    return 3 * p, p * t * t / (slots * (slots - 1)) * wedges


def affinity(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(both)).distinct()


def normalised_laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, value): D^-1/2 A D^-1/2 of the symmetric adjacency; nodes without edges don't occur."""
    a = affinity(edges)
    d = a.groupBy("src").agg(F.count("*").alias("d"))
    return a.join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst").select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("value"))


def _top_vectors(entries: DataFrame, k: int, seed: int, tolerance: float = 1e-8, rounds: int = 100, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the eigenvectors of the k largest eigenvalues as columns) of a symmetric sparse table (src, dst, value).

    Block Krylov spaces, begun anew from the best vectors until those settle: the table stays distributed and
    is multiplied with some k + 4 vectors at a time, which are on the driver, ``depth`` such blocks at most.
    """
    spark = entries.sparkSession
    ids = stored(numbered(entries.select(F.col("src").alias("id")).distinct(), "no", F.col("id")))
    names = ids.orderBy("no").select("id").toArrow()["id"].to_numpy()
    n = len(names)
    placed = entries.join(ids.select(F.col("id").alias("src"), F.col("no").alias("i")), "src").join(ids.select(F.col("id").alias("dst"), F.col("no").alias("j")), "dst")
    table = stored(placed.select(F.col("i").cast("int"), F.col("j").cast("int"), "value").repartitionByRange("i").sortWithinPartitions("i"))

    def times(x: np.ndarray) -> np.ndarray:
        sent, width = spark.sparkContext.broadcast(x), x.shape[1]

        def run(batches):
            for b in batches:
                i, j, v = (c.to_numpy() for c in b.columns)
                if len(i):
                    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    sums = np.add.reduceat(v[:, None] * sent.value[j], begin, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(i[begin]), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))], ["i", "y"])

        found = table.mapInArrow(run, "i int, y array<double>").toArrow()
        sent.destroy()
        out = np.zeros_like(x)
        np.add.at(out, found["i"].to_numpy(), found["y"].combine_chunks().flatten().to_numpy().reshape(-1, width))
        return out

    width = min(k + 4, n)
    best = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    product = times(best)
    for _ in range(rounds):
        basis, products = [best], [product]
        while len(basis) < min(depth, n // width):
            new, held = products[-1], np.hstack(basis)
            for _ in range(2):
                for _ in range(2):
                    new = new - held @ (held.T @ new)
                new = np.linalg.qr(new)[0]
            basis.append(new)
            products.append(times(new))
        q, aq = np.hstack(basis), np.hstack(products)
        h = q.T @ aq
        values, turned = np.linalg.eigh((h + h.T) / 2)
        best, product = q @ turned[:, -width:], aq @ turned[:, -width:]
        apart = np.linalg.norm(product[:, -k:] - best[:, -k:] * values[-k:], axis=0)
        if apart.max() <= tolerance:
            return names, best[:, -k:]
    raise RuntimeError("the eigenvectors don't settle")


def spectral_clusters(edges: DataFrame, k: int | None = None, most: int = 5000, normalize: str = "frobenius", seed: int = 1) -> DataFrame:
    """(id, cluster): k-means on the rows of the k largest eigenvectors; k by the largest gap unless given.

    Of up to ``most`` nodes all eigenvectors are found on the driver. Of more, the k largest are found by products
    with the distributed matrix, for which the driver holds some 16 (k + 4) numbers a node; the largest gap
    needs all eigenvalues, so more nodes without a k are refused.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = edges.sparkSession
    entries = stored(normalised_laplacian(edges))
    ids = [r[0] for r in entries.select("src").distinct().orderBy("src").limit(most + 1).collect()]
    if not ids:
        return spark.createDataFrame([], "id long, cluster int")
    if len(ids) > most:
        if k is None:
            raise ValueError(f"more than {most} nodes")
        ids, x = _top_vectors(entries, k, seed)
    else:
        at = {v: i for i, v in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        for s, d, v in entries.collect():
            m[at[s], at[d]] = v
        values, vectors = np.linalg.eigh(m)
        if k is None:
            k = len(ids) - 1 - int(np.argmax(np.diff(values))) if len(ids) > 1 else 1
        x = vectors[:, -k:]
    x = x / (np.linalg.norm(x) if normalize == "frobenius" else np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    held = pa.table({"id": pa.array(ids, pa.int64()), "row": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})
    rows = spark.createDataFrame(held).withColumn("features", array_to_vector("row"))
    if k == 1:
        return rows.select("id", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).select("id", "cluster")


def initial_parts(nodes: DataFrame, parts: int, policy: str = "round_robin", seed: int = 0) -> DataFrame:
    """(id, color): id mod parts, equal runs of ids, or random."""
    if policy == "round_robin":
        color = F.pmod("id", F.lit(parts))
    elif policy == "batch":
        n = nodes.count()
        return numbered(nodes.select("id"), "_no", F.col("id")).select("id", F.floor(F.col("_no") * parts / max(n, 1)).cast("int").alias("color"))
    else:
        color = F.floor(uniform(seed, F.col("id")) * parts)
    return nodes.select("id", color.cast("int").alias("color"))


def color_counts(colored: DataFrame) -> DataFrame:
    return colored.groupBy("color").agg(F.count("*").alias("n"))


def color_degrees(edges: DataFrame, colored: DataFrame) -> DataFrame:
    """(id, color, degree): neighbours of each colour, of a symmetric (src, dst) table."""
    return edges.join(colored.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "color").agg(F.count("*").alias("degree"))


def node_degrees(edges: DataFrame, colored: DataFrame, parts: int) -> DataFrame:
    """(id, color, degrees): each node's colour and how many neighbours it has of each of the colours 0 to parts - 1, of a symmetric table in which every node is."""
    of = edges.join(colored.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.count_if(F.col("color") == c).alias(f"_{c}") for c in range(parts)])
    return of.select("id", F.array(*[f"_{c}" for c in range(parts)]).alias("degrees")).join(colored, "id").select("id", "color", "degrees")


def edge_cut(edges: DataFrame, colored: DataFrame) -> DataFrame:
    """(edge_cut): edges between parts, of a symmetric table in which every edge is there twice."""
    both = edges.join(colored.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(colored.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst")
    return both.agg(F.expr("coalesce(sum(CAST(cs <> cd AS BIGINT)), 0) DIV 2").alias("edge_cut"))


def temperature(t: float, least: float, delta: float, policy: str = "exponential") -> float:
    """The next temperature."""
    return max(1.0, t - delta) if policy == "linear" else max(least, t * (1 - delta))


def schedule(rounds: int, t0: float = 2.0, least: float = 0.001, delta: float = 0.003, policy: str = "exponential", restart: int = 500) -> list[tuple[int, float]]:
    """(round, temperature) of each round; it starts anew after rounds that ``restart`` divides, the first one among them."""
    out, t = [], t0
    for r in range(rounds):
        out.append((r, t))
        t = t0 if r % restart == 0 else temperature(t, least, delta, policy)
    return out


def partner_sample(edges: DataFrame, near: int, seed: int, r: int) -> DataFrame:
    """(p, q): up to ``near`` neighbours of each node at random, of a symmetric table."""
    pick = F.row_number().over(Window.partitionBy("src").orderBy(uniform(seed, r, F.col("src"), F.col("dst")), "dst"))
    return edges.select("src", "dst", pick.alias("k")).filter(F.col("k") <= near).select(F.col("src").alias("p"), F.col("dst").alias("q"))


def random_sample(ids: DataFrame, n: int, far: int, seed: int, r: int) -> DataFrame:
    """(p, q): ``far`` draws for each node (id, no) from all n nodes, without the node itself."""
    drawn = ids.select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(far))).alias("k"))
    at = drawn.select("p", F.floor(uniform(seed, r, F.col("p"), F.col("k")) * max(n, 1)).cast("long").alias("no"))
    return at.join(ids, "no").select("p", F.col("id").alias("q")).filter("p <> q").distinct()


def exchange_gain(pairs: DataFrame, colored: DataFrame, degrees: DataFrame, alpha: float) -> DataFrame:
    """(p, q, cp, cq, old, new): same-colour degrees to the power alpha of pairs of two colours, before and after an exchange."""
    pairs = pairs.join(colored.select(F.col("id").alias("p"), F.col("color").alias("cp")), "p").join(colored.select(F.col("id").alias("q"), F.col("color").alias("cq")), "q").filter("cp <> cq")
    for node, color, name in (("p", "cp", "pp"), ("q", "cq", "qq"), ("p", "cq", "pq"), ("q", "cp", "qp")):
        pairs = pairs.join(degrees.select(F.col("id").alias(node), F.col("color").alias(color), F.col("degree").alias(name)), [node, color], "left")
    power = lambda c: F.pow(F.coalesce(c, F.lit(0)).cast("double"), F.lit(float(alpha)))
    return pairs.select("p", "q", "cp", "cq", (power("pp") + power("qq")).alias("old"), (power("pq") + power("qp")).alias("new"))


def node_gain(pairs: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """The same as ``exchange_gain``, of nodes (id, color, degrees), by one join for each end."""
    one = lambda node, color, name: nodes.select(F.col("id").alias(node), F.col("color").alias(color), F.col("degrees").alias(name))
    both = pairs.join(one("p", "cp", "dp"), "p").join(one("q", "cq", "dq"), "q").filter("cp <> cq")
    power = lambda degrees, color: F.pow(F.col(degrees)[F.col(color)].cast("double"), F.lit(float(alpha)))
    return both.select("p", "q", "cp", "cq", (power("dp", "cp") + power("dq", "cq")).alias("old"), (power("dp", "cq") + power("dq", "cp")).alias("new"))


def best_partners(pairs: DataFrame, colored: DataFrame, degrees: DataFrame, t: float = 1.0, alpha: float = 2.0) -> DataFrame:
    """(p, q, new): of each node's candidates (p, q) the one of the greatest benefit, of equals the lesser id; none if no exchange is worth it.

    A candidate counts if its benefit exceeds the node's degree in its own colour, and, times the
    temperature, the present one.
    """
    scored = exchange_gain(pairs, colored, degrees, alpha)
    own = degrees.join(colored, ["id", "color"]).select(F.col("id").alias("p"), F.col("degree").alias("own"))
    good = scored.join(own, "p", "left").filter((F.col("new") > F.coalesce("own", F.lit(0))) & (F.col("new") * t > F.col("old")))
    return good.groupBy("p").agg(F.max(F.struct("new", (-F.col("q")).alias("q"))).alias("m")).select("p", (-F.col("m.q")).alias("q"), "m.new")


def partition(edges: DataFrame, parts: int = 4, rounds: int = 1000, t0: float = 2.0, least: float = 0.001, delta: float = 0.003, alpha: float = 2.0, seed: int = 0, near: int = 3, far: int = 6, start: str = "round_robin", policy: str = "hybrid", cooling: str = "exponential", restart: int = 500) -> tuple[DataFrame, DataFrame]:
    """((id, color), (round, edge_cut, swaps, migrations)): parts of constant size with ever fewer edges between them.

    In a round every node draws up to ``near`` neighbours, or, where that finds no partner or the policy
    is "random", ``far`` other nodes; an exchange of colours scores by same-colour degrees to the power
    alpha before and after, and is accepted with probability exp(gain / t). Each node takes part in at most
    one exchange of a round, the one that both of its ends prefer, so sizes never change. swaps are counted
    from the beginning, migrations are the nodes that are not in their first part.
    """
    spark = edges.sparkSession
    links = stored(affinity(edges).filter("src <> dst"))
    ids = stored(numbered(links.select(F.col("src").alias("id")).distinct(), "no", F.col("id")))
    n = ids.count()
    first = colored = stored(initial_parts(ids, parts, start, seed))
    report, swapped = [], 0
    for r, t in schedule(rounds, t0, least, delta, cooling, restart):
        have = stored(node_degrees(links, colored, parts))

        def accepted(pairs, r=r, t=t, have=have):
            both = pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
            scored = node_gain(both, have, alpha).withColumn("gain", F.col("new") - F.col("old"))
            return scored.filter(F.exp(F.greatest(F.least(F.col("gain") / t, F.lit(50.0)), F.lit(-50.0))) > uniform(seed, r, F.col("p"), F.col("q"), "luck"))

        offers = accepted(partner_sample(links, near, seed, r)) if policy != "random" else None
        if policy != "local":
            others = random_sample(ids, n, far, seed, r)
            if offers is not None:
                offers = stored(offers)
                placed = offers.select(F.col("p").alias("p")).union(offers.select("q")).distinct()
                others = others.join(placed, "p", "left_anti")
            offers = accepted(others) if offers is None else offers.unionByName(accepted(others)).distinct()
        offers = stored(offers)
        order = F.struct("gain", -F.col("p"), -F.col("q"))
        ends = offers.select(F.col("p").alias("id"), order.alias("o")).union(offers.select(F.col("q").alias("id"), order.alias("o"))).groupBy("id").agg(F.max("o").alias("best"))
        swaps = offers.withColumn("o", order).join(ends.select(F.col("id").alias("p"), F.col("best").alias("bp")), "p").join(ends.select(F.col("id").alias("q"), F.col("best").alias("bq")), "q").filter("o = bp AND o = bq")
        swaps = stored(swaps.select("p", "q", "cp", "cq"))
        new = swaps.select(F.col("p").alias("id"), F.col("cq").alias("new")).union(swaps.select(F.col("q").alias("id"), F.col("cp").alias("new")))
        last, colored = colored, stored(colored.join(new, "id", "left").select("id", F.coalesce("new", "color").alias("color")))
        swapped += swaps.count()
        report.append((r, edge_cut(links, colored).first()[0], swapped, migrations(first, colored).first()[0]))
        release(have, offers, swaps, *([last] if last is not first else []))
    return colored, spark.createDataFrame(report, "round int, edge_cut long, swaps long, migrations long")


def migrations(first: DataFrame, colored: DataFrame) -> DataFrame:
    """(migrations): nodes whose part isn't the one they began in."""
    both = first.select("id", F.col("color").alias("_first")).join(colored, "id")
    return both.agg(F.count_if(F.col("_first") != F.col("color")).alias("migrations"))


def append_report(report: DataFrame, path: str) -> None:
    """Add the rows of a run's report to those that a folder has."""
    report.write.mode("append").parquet(path)


#: Edges up to which a graph is sent whole to every task of a sweep (16 bytes each, 32 MB).
SWEEP_EDGES = 2_000_000


def sweep(edges: DataFrame, grid: DataFrame, parts: int = 4) -> DataFrame:
    """grid (t0, least, delta, alpha, rounds, seed) with first_cut, edge_cut, swaps and migrations of a run node after node with each row.

    Runs are independent, one a task; the graph is shared by all, so one of more than SWEEP_EDGES edges is
    refused, and ``partition`` is there for it. A node tries one neighbour of three drawn, then one of six
    nodes drawn, and exchanges with probability exp(gain / t).
    """
    pairs = undirected(edges)
    table = pairs.limit(SWEEP_EDGES + 1).toPandas()
    if len(table) > SWEEP_EDGES:
        raise ValueError(f"more than {SWEEP_EDGES} edges")
    shared = edges.sparkSession.sparkContext.broadcast((table["a"].to_numpy(), table["b"].to_numpy()))
    names = ["t0", "least", "delta", "alpha", "rounds", "seed"]

    def run(batches):
        for rows in batches:
            found = [anneal(*shared.value, parts=parts, **{k: r[k] for k in names}) for r in rows[names].to_dict("records")]
            rows[["first_cut", "edge_cut", "swaps", "migrations"]] = found if found else np.zeros((0, 4), np.int64)
            yield rows

    wanted = grid.select(F.col("t0").cast("double"), F.col("least").cast("double"), F.col("delta").cast("double"), F.col("alpha").cast("double"), F.col("rounds").cast("int"), F.col("seed").cast("int"))
    return wanted.repartition(max(1, grid.count())).mapInPandas(run, wanted.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", first_cut long, edge_cut long, swaps long, migrations long")


def anneal(a: np.ndarray, b: np.ndarray, parts: int, t0: float, least: float, delta: float, alpha: float, rounds: int, seed: int, restart: int = 500) -> tuple[int, int, int, int]:
    """(first cut, last cut, swaps, migrations) of one run, node after node."""
    names, flat = np.unique(np.r_[a, b], return_inverse=True)
    n, a, b = len(names), flat[: len(a)], flat[len(a) :]
    around: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        around[x].append(y)
        around[y].append(x)
    color = [i % parts for i in range(n)]
    have = [[0] * parts for _ in range(n)]
    for x in range(n):
        for y in around[x]:
            have[x][color[y]] += 1
    cut = lambda: sum(color[x] != color[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    first, begun, swaps, rng = cut(), list(color), 0, random.Random(seed)
    for _, t in schedule(rounds, t0, least, delta, "exponential", restart):
        for p in range(n):
            for pool in (around[p], None):
                if pool is not None and not pool:
                    continue
                q = rng.choice(pool) if pool is not None else rng.randrange(n)
                cp, cq = color[p], color[q]
                gain = have[p][cq] ** alpha + have[q][cp] ** alpha - have[p][cp] ** alpha - have[q][cq] ** alpha
                if gain < 0 and math.exp(max(gain / t, -700.0)) <= rng.random():
                    continue
                if cp != cq:
                    color[p], color[q] = cq, cp
                    for x, old, new in ((p, cp, cq), (q, cq, cp)):
                        for y in around[x]:
                            have[y][old] -= 1
                            have[y][new] += 1
                swaps += 1
                break
    return first, cut(), swaps, sum(x != y for x, y in zip(begun, color, strict=True))


def acceptance(gain: Column, t: float) -> Column:
    """Probability to accept an exchange at a temperature."""
    return F.least(F.lit(1.0), F.exp(gain / t)) if t > 0 and math.isfinite(t) else (gain > 0).cast("double")
