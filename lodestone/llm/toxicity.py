"""Severity of toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - b_k) with one weight vector for all thresholds b_0 < b_1 < ...; the
output is the expected grade, the sum of those probabilities. x is sparse: whether a hashed word, or
word beginning of 5 or 6 bytes, occurs at least once, twice or four times in the text. Only features
that the likelihood-ratio test ties to the label get a weight, so that a long harmless text doesn't
add up the noise of hundreds of small ones.

``labels`` says only toxic or not. Where it has a column ``severity``, that is the grade; otherwise
toxic rows are graded 1 or 2 by whether the number of their features that the test ties to toxicity is
at most the median or above it.

The model is fitted on at most ``MAX_ROWS`` labelled rows, those of lowest hash, which is the bound
on what reaches the driver; every document is then scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.near_dedup import band_keys, minima
from lodestone.llm.shared import chunks, mix64, owner, text_of, tokens, utf8

#: Most labelled rows that a fit uses; documented bound of the training sample.
MAX_ROWS = 20_000
HASH_BITS, LEAST_TEST, RIDGE, THRESHOLD = 20, 24.0, 0.1, 0.5
PREFIXES, LEVELS = (5, 6), (1, 2, 4)
SIZE = len(LEVELS) << HASH_BITS


def features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and number of every feature that a text has, sorted; ``wanted`` tells which buckets matter."""
    lowered = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, h = tokens(lowered, offs)
    kinds = [(np.arange(len(starts)), h)]
    for k, length in enumerate(PREFIXES):
        at = np.flatnonzero(ends - starts > length)
        value = np.full(len(at), k + 1, np.uint64)
        for j in range(length):
            value = value << np.uint64(8) | lowered[starts[at] + j]
        kinds.append((at, mix64(value * np.uint64(0x9E3779B97F4A7C15))))
    row = owner(offs, starts)
    pairs = []
    for at, value in kinds:
        bucket = (value >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            at, bucket = at[hit], bucket[hit]
        pairs.append(row[at] << HASH_BITS | bucket)
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    out_row, out = [], []
    for level, least in enumerate(LEVELS):
        hit = pair[times >= least]
        out_row.append(hit >> HASH_BITS)
        out.append((hit & ((1 << HASH_BITS) - 1)) + (level << HASH_BITS))
    r, f = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    return r[order], f[order]


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> pa.Table:
    """(doc_id, grade, features ARRAY<INT>, bands BINARY) of the labelled rows of lowest hash.

    Rows with a null doc_id or a null label are left out; of rows that repeat a doc_id the highest
    label counts.
    """
    known = "severity" if "severity" in labels.columns else "toxic"
    grade = labels.filter(F.col("doc_id").isNotNull() & F.col(known).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(known).cast("int")).alias("grade"))
    picked = grade.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("__text"))

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            for lo, hi, part, cut in chunks(data, offs):
                row, w = features(part, cut)
                seg = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                m = band_keys(minima(part, cut, 3, 24), 3)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(seg), pa.array(w.astype(np.int32))), pa.array([x.tobytes() for x in m], pa.binary())],
                    ["doc_id", "grade", "features", "bands"],
                )

    joined = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "__text")
    return joined.mapInArrow(run, "doc_id long, grade int, features array<int>, bands binary").toArrow()


def distinct_rows(ids: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Rows in doc_id order of which no MinHash band was seen before, so that near copies count once."""
    seen: list[set] = [set() for _ in range(bands.shape[1])]
    out = []
    for r in np.argsort(ids, kind="stable"):
        new = True
        for s, v in zip(seen, bands[r].tolist(), strict=True):
            new &= v not in s
            s.add(v)
        if new:
            out.append(r)
    return np.array(out, np.int64)


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed G statistic of each word's document counts; positive where it goes with toxicity."""
    n = n_toxic + n_clean
    total = toxic + clean
    out = np.zeros(len(toxic))
    for observed, expected in ((toxic, total * n_toxic / n), (clean, total * n_clean / n), (n_toxic - toxic, (n - total) * n_toxic / n), (n_clean - clean, (n - total) * n_clean / n)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(observed > 0, observed * np.log(observed / np.maximum(expected, 1e-300)), 0)
    return 2 * out * np.sign(toxic * n_clean - clean * n_toxic)


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model, by Fisher scoring with step halving.

    P(y > k) = sigmoid(x.w - b_k); the loss is the mean negative log-likelihood of the grades plus
    ridge * |w|^2 / 2.
    """
    n, d = x.shape
    k = grades - 1
    above = np.array([(y > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    theta = np.r_[np.zeros(d), np.maximum.accumulate(-np.log(above / (1 - above)) + np.arange(k) * 1e-3)]

    def loss(t):
        b = t[d:]
        if (np.diff(b) <= 0).any():
            return np.inf, None
        under = np.c_[np.zeros(n), 1 / (1 + np.exp(np.clip((x @ t[:d])[:, None] - b, -40, 40))), np.ones(n)]  # P(y < k)
        p = np.maximum(np.diff(under, axis=1), 1e-12)
        return -np.log(p[np.arange(n), y]).mean() + ridge / 2 * (t[:d] ** 2).sum(), (under, p)

    def slopes(t, under, p):
        slope = under * (1 - under)  # of P(y < k) by b_k
        by_z = -np.diff(slope, axis=1)  # of p_g by z
        by_b = np.zeros((n, grades, k))
        for j in range(k):
            by_b[:, j, j], by_b[:, j + 1, j] = slope[:, j + 1], -slope[:, j + 1]
        own = p[np.arange(n), y]
        grad = np.r_[-x.T @ (by_z[np.arange(n), y] / own) / n + ridge * t[:d], -(by_b[np.arange(n), y] / own[:, None]).sum(axis=0) / n]
        info = np.zeros((d + k, d + k))
        info[:d, :d] = (x * (by_z**2 / p).sum(axis=1)[:, None]).T @ x
        info[:d, d:] = x.T @ ((by_z / p)[:, :, None] * by_b).sum(axis=1)
        info[d:, :d] = info[:d, d:].T
        info[d:, d:] = np.einsum("ngj,ngl,ng->jl", by_b, by_b, 1 / p)
        return grad, info / n + np.diag(np.r_[np.full(d, ridge), np.full(k, 1e-8)])

    value, at = loss(theta)
    for _ in range(steps):
        grad, info = slopes(theta, *at)
        step, size = np.linalg.solve(info, grad), 1.0
        while size > 1e-6:
            new, new_at = loss(theta - size * step)
            if new < value:
                break
            size /= 2
        else:
            break
        done = value - new < 1e-10
        theta, value, at = theta - size * step, new, new_at
        if done:
            break
    return theta[:d], theta[d:]


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each feature, thresholds). Without rows of two grades there is nothing to learn: weights of 0, one threshold of infinity."""
    table = sample(docs, labels, most)
    nothing = np.zeros(SIZE, np.float32), np.array([np.inf])
    if not table.num_rows:
        return nothing
    table = table.combine_chunks()
    ids, grade = table["doc_id"].to_numpy(), table["grade"].to_numpy()
    lists = table["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.int64).reshape(len(ids), -1)
    rows = distinct_rows(ids, bands)
    own = [values[offs[r] : offs[r + 1]] for r in rows]
    y = np.maximum(grade[rows], 0)
    toxic = y > 0
    if toxic.all() or not toxic.any():
        return nothing
    counts = np.zeros((2, SIZE))
    for w, t in zip(own, toxic, strict=True):
        counts[int(t)][w] += 1
    g = likelihood_ratio(counts[1], counts[0], int(toxic.sum()), int((~toxic).sum()))
    chosen = np.flatnonzero(np.abs(g) >= LEAST_TEST)
    if not len(chosen):
        return nothing
    if "severity" not in labels.columns:
        tied = np.zeros(SIZE, bool)
        tied[chosen[g[chosen] > 0]] = True
        amount = np.array([tied[w].sum() for w in own])
        y = np.where(toxic, 1 + (amount > np.median(amount[toxic])), 0)
    present = sorted(set(y.tolist()))
    y = np.searchsorted(present, y)
    column = np.full(SIZE, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(own), len(chosen)))
    for i, w in enumerate(own):
        at = column[w]
        x[i, at[at >= 0]] = 1
    w, b = fit_ordinal(x, y, len(present), RIDGE / len(own))
    weight = np.zeros(SIZE, np.float32)
    weight[chosen] = w
    return weight, b


def severity(spark: SparkSession, weight: np.ndarray, thresholds: np.ndarray) -> Column:
    """Expected grade of the column text."""
    model = spark.sparkContext.broadcast((weight, thresholds))

    def run(texts: pa.Array) -> pa.Array:
        weight, b = model.value
        wanted = (weight.reshape(len(LEVELS), -1) != 0).any(axis=0)
        data, offs = utf8(texts)
        z = np.zeros(len(offs) - 1)
        for lo, hi, part, cut in chunks(data, offs):
            row, f = features(part, cut, wanted)
            z[lo:hi] += np.bincount(row, weight[f], hi - lo)
        with np.errstate(over="ignore"):
            return pa.array(np.round((1 / (1 + np.exp(b[None, :] - z[:, None]))).sum(axis=1), 6))

    return F.arrow_udf(run, "double")(text_of())


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, severity, toxic) of every row of docs.

    A null text counts as empty; a text without a telling word has the severity of the thresholds
    alone. Null and repeated doc_ids are scored like any other row. Other columns are ignored.
    """
    scored = docs.select("doc_id", severity(docs.sparkSession, *fit(docs, labels, most)).alias("severity"))
    return scored.withColumn("toxic", F.col("severity") >= threshold)


def op10_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_toxicity`` of all documents, fitted on the labels, with the defaults; its cases are stated there."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
