"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are trained by Lloyd iterations, whose partial sums
are all that is gathered, over the ``PER_LIST`` x lists vectors of lowest hash. Every vector is indexed:
it is encoded once, and its list, code and residual error are stored beside it. The queries, by default
the vectors whose id is divisible by ``EVERY``, ask the lists nearest to them. How many is measured: the
exact neighbours of ``PILOTS`` queries are found by one scan of all vectors, and the least number of
lists is taken that holds the share ``RECALL`` of them; few where vectors cluster, many where they don't.

Lists that lie together form groups of about ``BLOCK`` vectors. A query is sent once to each group
that has lists it asks. There, tables of its inner products with the codewords give asymmetric
distances to the codes; the ``RERANK`` best of the group are measured exactly, then whatever may, by
its quantisation error, be as near as the K-th of these, so that nothing in the lists asked is lost
and the share of lists is the recall. The best ``K`` over all groups remain. A larger group is cut into
blocks, and so are the queries that it meets, so that no task holds more than a block of each; a vector
is shipped once for each block of queries.

The number of lists grows as the root of the number of vectors, up to ``MOST_LISTS``, which bounds the
broadcast centroids (4 bytes x dimensions x lists, 26 MB for 64 dimensions) and the training sample;
beyond ten billion vectors lists grow longer instead, and the share of them to ask is measured as ever.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import join_small, materialize, utf8

K, RECALL, PILOTS, RERANK, PARTS, CODES, ROUNDS = 10, 0.95, 256, 256, 16, 64, 8
#: Lists are at most this many, for a broadcast and a training sample of bounded size.
MOST_LISTS = 100_000
#: Vectors of the training sample for each list.
PER_LIST = 64
#: Vectors whose id is divisible by this are the queries.
EVERY = 50
#: Vectors, and queries, that one task compares.
BLOCK = 20_000


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), dim)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest row of c for each row of x; the first of equals."""
    half = (c * c).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 2048):
        out[lo : lo + 2048] = (half - x[lo : lo + 2048] @ c.T).argmin(axis=1)
    return out


def _means(vectors: DataFrame, part_of, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by (part, nearest) over all vectors; part_of gives (numbers, rows) of a batch."""

    def run(batches):
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for b in batches:
            at, rows = part_of(b)
            for lo in range(0, len(at), 1 << 16):
                one = np.zeros((k, dim))
                order = np.argsort(at[lo : lo + (1 << 16)], kind="stable")
                own = at[lo : lo + (1 << 16)][order]
                if len(own):
                    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    one[own[cut]] = np.add.reduceat(rows[lo : lo + (1 << 16)][order].astype(np.float64), cut)
                sums += one
            counts += np.bincount(at, minlength=k)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has]), pa.array(list(sums[has]), pa.list_(pa.float64()))], ["c", "n", "s"])

    add = F.aggregate(F.collect_list("s"), F.array_repeat(F.lit(0.0), dim), lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y))
    table = vectors.mapInArrow(run, "c long, n long, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), add.alias("s")).toArrow()
    sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
    at = table["c"].to_numpy()
    if len(at):
        counts[at] = table["n"].to_numpy()
        sums[at] = np.array(table["s"].to_pylist())
    return sums, counts


def _clean(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(id, vec ARRAY<FLOAT>) of usable rows, in the shared folder, and the dimension."""
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("vec"))
    src = src.filter("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e18)")
    kept = materialize(src.groupBy("id").agg(F.min("vec").alias("vec")))
    sizes = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not sizes:
        return kept, 0
    dim = sizes[0]["d"]
    return kept.filter(F.size("vec") == dim), dim


def train(vectors: DataFrame, n: int, dim: int, rounds: int = ROUNDS, parts: int = PARTS, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(coarse centroids, codebooks (parts, codes, dim / parts)) of (id, vec), by the sample of PER_LIST vectors for each list."""
    lists = int(min(MOST_LISTS, max(1, math.isqrt(n))))
    seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(max(lists, min(n, codes))).toArrow()
    share = PER_LIST * max(lists, codes) / n
    if share < 1:  # an even hash takes about that many
        vectors = materialize(vectors.filter(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 40)) < int(share * (1 << 40))))
    x = _matrix(seeds["vec"].combine_chunks(), dim)
    coarse = x[:lists]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(coarse)

        def assign(b, shared=shared):
            m = _matrix(b.column(1), dim)
            return nearest(m, shared.value), m

        sums, counts = _means(vectors, assign, len(coarse), dim)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], coarse).astype(np.float32)
        done = np.allclose(new, coarse, atol=1e-6)
        coarse = new
        if done:
            break
    sub = dim // parts
    first = x[: min(len(x), codes)]
    residual = first - coarse[nearest(first, coarse)]
    rng = np.random.default_rng(7)
    scale = np.abs(residual).max(initial=1e-6)
    books = np.concatenate([residual, rng.normal(0, scale / 2, (codes - len(residual), dim)).astype(np.float32)]) if len(residual) < codes else residual
    books = books.reshape(codes, parts, sub).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast((coarse, books))

        def assign(b, shared=shared):
            coarse, books = shared.value
            m = _matrix(b.column(1), dim)
            r = (m - coarse[nearest(m, coarse)]).reshape(len(m), parts, sub)
            at = [nearest(r[:, p], books[p]) + p * codes for p in range(parts)]
            return np.concatenate(at), r.transpose(1, 0, 2).reshape(-1, sub)

        sums, counts = _means(vectors, assign, parts * codes, sub)
        flat = books.reshape(parts * codes, sub)
        books = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], flat).astype(np.float32).reshape(parts, codes, sub)
    return coarse, books


def probes_needed(vectors: DataFrame, coarse: np.ndarray, dim: int, k: int, recall: float) -> int:
    """The least number of lists to ask that holds the share ``recall`` of the pilots' exact neighbours."""
    pilots = vectors.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(PILOTS).toArrow()
    ids, q = pilots["id"].to_numpy(), _matrix(pilots["vec"].combine_chunks(), dim)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q, coarse))

    def run(batches):
        ids, q, coarse = shared.value
        for b in batches:
            v, v_id = _matrix(b.column(1), dim), b.column(0).to_numpy()
            far = (q * q).sum(axis=1)[:, None] - 2 * q @ v.T + (v * v).sum(axis=1)
            far[ids[:, None] == v_id] = np.inf
            top = np.argsort(far, axis=1, kind="stable")[:, :k]
            cols = np.repeat(np.arange(len(ids)), top.shape[1]), v_id[top.ravel()], np.take_along_axis(far, top, axis=1).ravel().astype(np.float64), nearest(v, coarse)[top.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "id", "far", "list"])

    found = vectors.mapInArrow(run, "q long, id long, far double, list long").filter("far < 1e300")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
    true = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "list").toArrow()
    if not true.num_rows:
        return 1
    place = np.argsort(np.argsort((coarse * coarse).sum(axis=1) / 2 - q @ coarse.T, axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(place[true["q"].to_numpy(), true["list"].to_numpy()])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def group_lists(coarse: np.ndarray, groups: int) -> np.ndarray:
    """Group of each list, near ones together."""
    if groups >= len(coarse):
        return np.arange(len(coarse))
    centre = coarse[:: len(coarse) // groups][:groups].copy()
    for _ in range(5):
        at = nearest(coarse, centre)
        for g in np.unique(at):
            centre[g] = coarse[at == g].mean(axis=0)
    return nearest(coarse, centre)


def _encode(vectors: DataFrame, coarse: np.ndarray, books: np.ndarray, group: np.ndarray) -> DataFrame:
    """(grp, id, vec, list, code): the index, a row for each vector; code has a byte for each part."""
    dim, parts = coarse.shape[1], len(books)
    shared = vectors.sparkSession.sparkContext.broadcast((coarse, books, group))

    def run(batches):
        coarse, books, group = shared.value
        for b in batches:
            v = _matrix(b.column(1), dim)
            home = nearest(v, coarse)
            residual = (v - coarse[home]).reshape(len(v), parts, -1)
            code = np.stack([nearest(residual[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(v), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(group[home].astype(np.int64)), b.column(0), b.column(1), pa.array(home.astype(np.int32)), packed], ["grp", "id", "vec", "list", "code"])

    return vectors.mapInArrow(run, "grp long, id long, vec array<float>, list int, code binary")


def _ask(queries: DataFrame, coarse: np.ndarray, group: np.ndarray, probes: int) -> DataFrame:
    """(grp, id, vec, lists): each query once for each group with lists that it asks."""
    dim = coarse.shape[1]
    shared = queries.sparkSession.sparkContext.broadcast((coarse, group))

    def run(batches):
        c, group = shared.value
        half = (c * c).sum(axis=1) / 2
        n = min(probes, len(c))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                far = half - _matrix(part.column(1), dim) @ c.T
                top = np.argpartition(far, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(top)), n)
                order = np.lexsort((top.ravel(), group[top.ravel()], row))
                row, lists = row[order], top.ravel()[order]
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[lists[1:]] != group[lists[:-1]])])
                at, grp = row[cut], group[lists[cut]]
                cols = [pa.array(grp.astype(np.int64)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(np.r_[cut, len(lists)].astype(np.int32)), pa.array(lists.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, ["grp", "id", "vec", "lists"])

    return queries.mapInArrow(run, "grp long, id long, vec array<float>, lists array<int>")


def _squared(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact squared distances of q[row] and v[col]."""
    out = np.empty(len(row))
    for i in range(0, len(row), 1 << 14):
        out[i : i + (1 << 14)] = ((q[row[i : i + (1 << 14)]] - v[col[i : i + (1 << 14)]]).astype(np.float64) ** 2).sum(axis=1)
    return out


def search_block(q: np.ndarray, q_id: np.ndarray, asks: np.ndarray, v: np.ndarray, v_id: np.ndarray, home: np.ndarray, code: np.ndarray, coarse: np.ndarray, books: np.ndarray, k: int, rerank: int):
    """(query, neighbour, squared distance) of the best k in one block.

    coarse has the block's lists, home the list of each vector, code (parts, vectors) its code and asks
    (queries, lists) which lists a query asks. With c the centroid and r the quantised residual, |q - c - r|^2 is |q|^2 plus
    |c + r|^2, known for each vector, minus 2 q.c, known for each list, minus 2 q.r, which is summed
    from tables of q's inner products with pairs of codewords. ``rerank`` is how many by code give the
    first bound; the result doesn't depend on it.
    """
    parts, codes, sub = books.shape
    code = code.astype(np.int64)
    near = coarse[home] + np.concatenate([books[p][code[p]] for p in range(parts)], axis=1)
    own = (near * near).sum(axis=1)
    whole = (v * v).sum(axis=1)
    error = np.sqrt(((v - near).astype(np.float64) ** 2).sum(axis=1))
    scale = 2 * ((coarse * coarse).sum(axis=1)[home] + whole + own)
    pairs = [(p, p + 1) for p in range(0, parts - 1, 2)]
    both = [code[a] * codes + code[b] for a, b in pairs]
    out = []
    for lo in range(0, len(q), 256):
        some = q[lo : lo + 256]
        split = some.reshape(len(some), parts, sub)
        far = (-2 * (coarse @ some.T))[home] + own[:, None]
        for (a, b), at in zip(pairs, both, strict=True):
            table = (books[a] @ split[:, a].T)[:, None, :] + (books[b] @ split[:, b].T)[None, :, :]
            table *= -2
            far += table.reshape(codes * codes, len(some))[at]
        if parts % 2:
            far += (-2 * (books[-1] @ split[:, -1].T))[code[-1]]
        far[~asks[lo : lo + 256].T[home]] = np.inf
        far = np.ascontiguousarray(far.T)
        far[q_id[lo : lo + 256, None] == v_id[None, :]] = np.inf
        # the k-th exact distance of the best by code bounds that of all; what may be nearer by its quantisation error is measured too
        top = np.argpartition(far, rerank - 1, axis=1)[:, :rerank] if rerank < len(v) else np.broadcast_to(np.arange(len(v)), far.shape)
        first = _squared(some, v, np.repeat(np.arange(len(some)), top.shape[1]), top.ravel()).reshape(top.shape)
        first[~np.isfinite(np.take_along_axis(far, top, axis=1))] = np.inf
        bound = np.partition(first, k - 1, axis=1)[:, k - 1] if k < top.shape[1] else np.full(len(some), np.inf)
        size = (some * some).sum(axis=1)
        slack = 2e-5 * (size[:, None] + scale)  # of single precision
        maybe = np.isfinite(far) & (far + size[:, None] - slack <= (np.sqrt(bound)[:, None] + error) ** 2)
        used = np.flatnonzero(maybe.any(axis=0))
        near_by = size[:, None] + whole[used] - 2 * some @ v[used].T
        row, col = np.nonzero(maybe[:, used] & (near_by - 2e-5 * (size[:, None] + whole[used]) <= bound[:, None]))
        col = used[col]
        exact = _squared(some, v, row, col)
        order = np.lexsort((v_id[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((q_id[lo + row[best]], v_id[col[best]], exact[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def neighbours(vectors: DataFrame, k: int = K, recall: float = RECALL, rerank: int = RERANK, parts: int = PARTS, codes: int = CODES, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour, rank, distance): for each query its k nearest others, of all vectors, by Euclidean distance.

    Queries are the vectors whose id is divisible by ``every`` (1: all). Equal distances are ordered by
    id. A query has fewer neighbours only if the lists it asks hold fewer. Rows whose id or vector is
    null, empty, or holds a null, a NaN or an infinite value, and rows of another length than most, are
    neither queries nor neighbours; of rows that repeat an id the smallest vector counts. An empty table
    gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    clean, dim = _clean(vectors, key, column)
    n = clean.count() if dim else 0
    if n < 2:
        return spark.createDataFrame([], f"`{key}` long, neighbour long, rank int, distance double")
    while dim % parts:
        parts -= 1
    coarse, books = train(clean, n, dim, parts=parts, codes=codes)
    group = group_lists(coarse, -(-n // block))
    probes = probes_needed(clean, coarse, dim, k, recall)
    index = materialize(_encode(clean, coarse, books, group))
    asked = materialize(_ask(clean.filter(F.pmod("id", F.lit(every)) == 0), coarse, group, probes))
    held_by, asking_by = index.groupBy("grp").agg(F.count("*").alias("held")), asked.groupBy("grp").agg(F.count("*").alias("asking"))
    blocks = materialize(held_by.join(asking_by, "grp").select("grp", F.expr(f"ceil(held / {block})").alias("v_blocks"), F.expr(f"ceil(asking / {block})").alias("q_blocks")))
    salt = F.xxhash64("id")
    held = join_small(index, blocks, "grp", "inner").withColumn("q", F.explode(F.expr("sequence(0L, q_blocks - 1L)"))).select(F.col("grp").alias("g"), F.pmod(salt, "v_blocks").alias("v"), "q", F.col("id").alias("held_id"), F.col("vec").alias("held_vec"), F.col("list").alias("held_home"), F.col("code").alias("held_code"))
    asking = join_small(asked, blocks, "grp", "inner").withColumn("vb", F.explode(F.expr("sequence(0L, v_blocks - 1L)"))).select("grp", "vb", F.pmod(salt, "q_blocks").alias("qb"), "id", "vec", "lists")
    model = spark.sparkContext.broadcast((coarse, books))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coarse, books = model.value
        names = ["id", "neighbour", "squared"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        left, right = left.combine_chunks(), right.combine_chunks()
        one = lambda t, name: (t[name].chunk(0) if isinstance(t[name], pa.ChunkedArray) else t[name])
        used, home = np.unique(one(right, "held_home").to_numpy(), return_inverse=True)
        lists = one(left, "lists")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[ends[0] : ends[-1]]
        at = np.searchsorted(used, flat).clip(max=len(used) - 1)
        hit = used[at] == flat
        asks = np.zeros((left.num_rows, len(used)), bool)
        asks[np.repeat(np.arange(left.num_rows), np.diff(ends))[hit], at[hit]] = True
        code = utf8(one(right, "held_code"))[0].reshape(right.num_rows, len(books)).T
        found = search_block(_matrix(one(left, "vec"), dim), one(left, "id").to_numpy(), asks, _matrix(one(right, "held_vec"), dim), one(right, "held_id").to_numpy(), home, code, coarse[used], books, k, rerank)
        return pa.table([pa.array(x) for x in found], names)

    found = asking.groupBy("grp", "vb", "qb").cogroup(held.groupBy("g", "v", "q")).applyInArrow(run, "id long, neighbour long, squared double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("squared", "neighbour"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias(key), "neighbour", "rank", F.round(F.sqrt("squared"), 6).alias("distance"))


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``neighbours`` of every vector whose id is divisible by 50, among all vectors, with the defaults; its cases are stated there."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
