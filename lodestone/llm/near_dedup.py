"""b-bit MinHash near-duplicate detection.

Each document's set of word shingles is hashed with ``PERMUTATIONS`` linear permutations of 32-bit
space. Whole minima form the band keys; of each minimum only the low ``bits`` bits are retained and
packed into the signature. Documents that share a band key are candidates, and their Jaccard
similarity is estimated from the count of equal b-bit values, corrected for chance collisions:
J = (E - 2^-b) / (1 - 2^-b).

Groups are the connected components of "candidate pair with estimate >= threshold". No pair is
skipped and no bucket is capped: equal signatures are collapsed first, and in a bucket the
components are grown breadth-first against the members that are not reached yet, so a dense
bucket costs about one vectorised comparison a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import chunks, join_small, lean, materialize, mix64, owner, release, sorted_groups, text_of, tokens, utf8

SHINGLE, PERMUTATIONS, BITS, ROWS, THRESHOLD = 2, 128, 4, 4, 0.6


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minima(data: np.ndarray, offs: np.ndarray, shingle: int, k: int) -> np.ndarray:
    """(texts, k) minima; a text with fewer words than a shingle has one shingle of all its words, one without words 2^32 - 1 throughout."""
    n = len(offs) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    lowered = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, _, h = tokens(lowered, offs)
    if not len(h):
        return out
    doc = owner(offs, starts)
    value = h.copy()
    alive = np.ones(len(h), bool)
    for j in range(1, shingle):
        same = np.zeros(len(h), bool)
        same[:-j] = doc[j:] == doc[:-j]
        value[:-j] = np.where(same[:-j], value[:-j] * np.uint64(0x9FB21C651E98DF25) + h[j:], value[:-j])
        alive &= same
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    alive[first] = True
    x = (mix64(value[alive]) >> np.uint64(32)).astype(np.uint32)
    doc = doc[alive]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    a, b = _coefficients(k)
    buf = np.empty_like(x)
    rows = doc[cut]
    for i in range(k):
        np.multiply(x, a[i], out=buf)
        buf += b[i]
        out[rows, i] = np.minimum.reduceat(buf, cut)
    return out


def pack(mins: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each minimum, packed into bytes, 8 / bits to a byte."""
    per = 8 // bits
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint8).reshape(len(mins), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint8) * np.uint8(bits)), axis=2)


def estimate(one: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    """Collision-corrected Jaccard estimates of packed signatures by counting differing bit groups."""
    x = one ^ many
    fold = x
    for s in range(1, bits):
        fold = fold | (x >> np.uint8(s))
    mask = sum(1 << s for s in range(0, 8, bits))
    differ = np.bitwise_count(fold & np.uint8(mask)).sum(axis=-1, dtype=np.int64)
    k, c = x.shape[-1] * 8 // bits, 0.5**bits
    return ((k - differ) / k - c) / (1 - c)


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` whole minima, different in every band."""
    n, k = mins.shape
    m = mins[:, : k // rows * rows].reshape(n, -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(m.shape[1], dtype=np.uint64) + np.uint64(1), m.shape[:2])
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, k: int = PERMUTATIONS, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """(doc_id, sig BINARY, bands ARRAY<BIGINT>) of every document with a doc_id and at least one word."""

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            ids = b.column(0)
            for lo, hi, part, cut in chunks(data, offs):
                m = minima(part, cut, shingle, k)
                has = np.flatnonzero((m != 0xFFFFFFFF).any(axis=1))
                if len(has):
                    p, keys = pack(m[has], bits), band_keys(m[has], rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(lo, hi - lo).take(pa.array(has)),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(p.shape[1]), len(p), [None, pa.py_buffer(np.ascontiguousarray(p))]).cast(pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                        ],
                        ["doc_id", "sig", "bands"],
                    )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id IS NOT NULL")
    return src.mapInArrow(lean(run), "doc_id long, sig binary, bands array<long>")


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the components of one bucket under estimate >= threshold."""
    left = np.arange(len(ids))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = estimate(sigs[at], sigs[left], bits) >= threshold
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), ids[at]))
                b.append(ids[new])
                queue += new.tolist()
                left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _buckets(rep: DataFrame) -> DataFrame:
    """(bucket, id) of every set of documents that shares some band key; a set that several keys share is one bucket."""

    def run(batches):
        for t in sorted_groups(batches):
            keys, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[cut, len(keys)])
            name = mix64(np.add.reduceat(mix64(ids.view(np.uint64)), cut) + size.astype(np.uint64)).view(np.int64)
            many = np.repeat(size > 1, size)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[many]), pa.array(ids[many])], ["bucket", "id"])

    banded = rep.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    return banded.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "bucket long, id long").distinct()


def _edges(members: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Verified spanning edges of every bucket, from (bucket, id, sig)."""

    def run(batches):
        for t in sorted_groups(batches):
            keys, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
            size = np.diff(cut)
            sigs = utf8(t.column(2).combine_chunks())[0].reshape(len(ids), -1)
            two = cut[:-1][size == 2]
            ok = two[estimate(sigs[two], sigs[two + 1], bits) >= threshold]
            a, b = [ids[ok]], [ids[ok + 1]]
            for lo, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
                x, y = bucket_edges(ids[lo : lo + n], sigs[lo : lo + n], bits, threshold)
                a, b = [*a, x], [*b, y]
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return members.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root): the smallest id of each connected component, by alternating star contractions.

    Every round sends each node's neighbours to the smallest of them; edges are written to the
    shared folder between rounds and rounds end when the edge set no longer changes.
    """
    now, before = materialize(edges.select("a", "b").filter("a <> b").distinct()), None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(small, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        last, now = now, materialize(star)
        release(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).union(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, k: int = PERMUTATIONS, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, similarity, keep): one row for each document that has a near copy.

    group_id is the smallest doc_id of the group, which is the one to keep; similarity is the
    estimate against it. Documents without a near copy have no row. Rows with a null doc_id and
    texts without a word (null, empty, punctuation) are never grouped. Rows that repeat a doc_id
    count as one document, of which one signature (the smallest) is used. Other columns are ignored.
    """
    sig = materialize(signatures(docs, shingle, k, bits, rows).groupBy("doc_id").agg(F.min(F.struct("sig", "bands")).alias("s")).select("doc_id", "s.sig", "s.bands"))
    rep = materialize(sig.groupBy("bands", "sig").agg(F.min("doc_id").alias("rep"), F.collect_list("doc_id").alias("ids")))
    members = _buckets(rep).join(rep.select(F.col("rep").alias("id"), "sig"), "id").select("bucket", "id", "sig")
    root = components(_edges(members, bits, threshold))
    grouped = rep.join(root, rep.rep == root.id, "left").filter("root IS NOT NULL OR size(ids) > 1")
    member = grouped.select(F.explode("ids").alias("doc_id"), F.coalesce("root", "rep").alias("group_id"), "sig")
    anchor = rep.select(F.col("rep").alias("group_id"), F.col("sig").alias("other"))

    def score(sig: pa.Array, other: pa.Array) -> pa.Array:
        n = len(sig)
        if not n:
            return pa.array([], pa.float64())
        a, b = utf8(sig)[0].reshape(n, -1), utf8(other)[0].reshape(n, -1)
        return pa.array(np.round(estimate(a, b, bits), 6))

    similar = F.arrow_udf(score, "double")
    return member.join(anchor, "group_id").select("doc_id", "group_id", similar("sig", "other").alias("similarity"), (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without all but the first of each group; columns as given.

    Repeated rows of one doc_id are one document: if there are any, one row of each stays.
    """
    found = near_duplicates(docs, **parameters)
    gone = materialize(found.filter("NOT keep").select("doc_id"))
    ids = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = materialize(ids)
    n = repeated.count()
    if n:
        mark = join_small(docs, repeated.withColumn("__again", F.lit(True)), "doc_id", "left", n)
        docs = mark.filter("__again IS NULL").drop("__again").unionByName(mark.filter("__again").drop("__again").dropDuplicates(["doc_id"])).select(docs.columns)
    return join_small(docs, gone, "doc_id", "left_anti").select(docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents, with the defaults; its cases are stated there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
