"""Quality rule: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

The n-grams are the runs of ``GRAM`` = 6 bytes of a text's UTF-8 form; gram value v has the key
((v * 11400714819323198485) mod 2^64) >> 32, so wide that grams hardly ever share one, and the table
of keys grows with the corpus. Two multinomials are fitted over whole tables: the trusted one over
the documents labelled quality = 1, the raw one over every document, whose languages are weighted to
the shares that they have in the trusted part, so that a language of which little is labelled isn't
taken for a fault. Both are smoothed by ``PSEUDO`` counts, in the raw scale, so that rare n-grams say
little. log(trusted / raw) of a key is rounded to ``1 / UNIT``, so that sums of them are exact in any
order. A document's score is their mean over its n-grams, so it doesn't grow with length; ``PRIOR``
further n-grams that speak neither way are counted in, so that a few odd n-grams don't condemn a short
text. It is kept if the score is at least ``THRESHOLD``.

What is shuffled is one row for each language, key and input partition. The ratios are broadcast, 8
bytes each, while they are at most ``BROADCAST_KEYS``; beyond that the documents' counts of keys are
joined with them by a shuffle, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import chunks, give_back, join_small, lean, materialize, text_of, utf8

GRAM, PSEUDO, PRIOR, THRESHOLD, UNIT = 6, 50, 16, -0.1, 10_000
#: Keys up to which the ratios are broadcast (8 bytes each, 256 MB).
BROADCAST_KEYS = 32_000_000
#: Counted keys that a task holds before it hands them on.
HELD_KEYS = 2_000_000
#: Keys that are merged at a time, and bytes of text whose grams are taken at a time.
MERGED_KEYS, GRAM_BYTES = 1 << 17, 1 << 19
_FACTOR, _SHIFT = 11400714819323198485, 100_000_000


def keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (UINT32) of every gram, and offsets by text."""
    n = len(data) - GRAM + 1
    cut = np.r_[0, np.cumsum(np.maximum(np.diff(offs) - GRAM + 1, 0))]
    if n <= 0 or not cut[-1]:
        return np.zeros(0, np.uint32), cut
    v = data[:n].astype(np.uint64)
    for j in range(1, GRAM):
        v <<= np.uint64(8)
        v |= data[j : n + j]
    v *= np.uint64(_FACTOR)
    v >>= np.uint64(32)
    whole = np.ones(n, bool)
    for j in range(1, GRAM):
        at = offs[1:-1] - j
        whole[at[(at >= 0) & (at < n)]] = False
    return v[whole].astype(np.uint32), cut


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of keys with the sums of their counts, of sorted lists.

    They are merged by ranges of keys, so that besides parts and result little is held.
    """
    whole = sum(len(key) for key, _ in parts)
    some = np.sort(np.concatenate([key[::64] for key, _ in parts]))
    bounds = np.unique(some[MERGED_KEYS // 64 :: MERGED_KEYS // 64])
    places = [np.r_[0, np.searchsorted(key, bounds), len(key)] for key, _ in parts]
    out, sums, size = np.empty(whole, np.uint64), np.empty(whole, np.int64), 0
    for i in range(len(bounds) + 1):
        key, n = (np.concatenate([part[j][at[i] : at[i + 1]] for part, at in zip(parts, places, strict=True)]) for j in (0, 1))
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[size : size + len(cut)], sums[size : size + len(cut)] = key[cut], np.add.reduceat(n, cut, dtype=np.int64)
        size += len(cut)
    return out[:size], sums[:size]


def _counts(batches, held_keys: int = HELD_KEYS):
    """(lang, key, raw, trusted) counts from batches of (text, trusted, lang); a key comes again when more than ``held_keys`` are met."""
    names: dict[str, int] = {}
    parts, held = [], 0

    def rows():
        code, n = _merged(parts)
        parts.clear()
        known = pa.array(list(names), pa.string())
        for lo in range(0, len(code), 1 << 16):
            c, m = code[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)]
            key, good, own = (c >> np.uint64(1)) & np.uint64(0xFFFFFFFF), (c & np.uint64(1)).astype(bool), (c >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(own)), pa.array(key.astype(np.int64)), pa.array(m), pa.array(np.where(good, m, 0))], ["lang", "key", "raw", "trusted"])

    for b in batches:
        data, offs = utf8(b.column(0))
        t = b.column(1).to_numpy(zero_copy_only=False)
        coded = b.column(2).dictionary_encode()
        place = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.uint64)
        mark = (place[coded.indices.to_numpy(zero_copy_only=False)] << np.uint64(33)) | t.astype(np.uint64)
        for lo, hi, part, cut in chunks(data, offs, GRAM_BYTES):
            k, seg = keys(part, cut)
            code = k.astype(np.uint64)
            code <<= np.uint64(1)
            code |= np.repeat(mark[lo:hi], np.diff(seg))
            code.sort()
            at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            parts.append((code[at], np.diff(np.r_[at, len(code)]).astype(np.int32)))
            held += len(at)
            del k, seg, code, at
            if held > held_keys:
                parts[:] = [_merged(parts)]
                held = len(parts[0][0])
                if held > held_keys * 3 // 4:
                    yield from rows()
                    held = 0
    if held:
        yield from rows()


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, key, raw, trusted) counts over all documents; a null language, or none, is the empty one."""
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__trusted")).distinct()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    src = docs.select(F.col("doc_id").alias("__id"), text_of().alias("__text"), lang.alias("__lang"))
    marked = join_small(src, trusted.withColumn("__id", F.col("__trusted")), "__id", "left").select("__text", F.col("__trusted").isNotNull().alias("t"), "__lang")

    return marked.mapInArrow(lean(_counts), "lang string, key long, raw long, trusted long").groupBy("lang", "key").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, ratio): log(trusted / raw) in units of 1 / UNIT of each key for which it isn't 0; no row if there is no trusted document."""
    per = materialize(gram_counts(docs, labels))
    totals = materialize(per.groupBy("lang").agg(F.sum("raw").alias("in_raw"), F.sum("trusted").alias("in_good")))
    raw, good = totals.agg(F.sum("in_raw"), F.sum("in_good")).first()
    if not good:
        return per.select("key", F.lit(0).alias("ratio")).limit(0)
    weighted = join_small(per, totals.select("lang", (F.col("in_good") / F.col("in_raw")).alias("share")), "lang", "inner").groupBy("key").agg(F.sum(F.col("raw") * F.col("share")).alias("w"), F.sum("trusted").alias("good"))
    ratio = F.log(F.col("good") * (raw / good) + PSEUDO) - F.log(F.col("w") * (raw / good) + PSEUDO)
    return materialize(weighted.select("key", F.round(ratio * UNIT).cast("int").alias("ratio")).filter("ratio <> 0"))


def _micro(total: str, n: str) -> str:
    """SQL of the score in millionths, by whole numbers, so that every engine rounds alike."""
    return f"(({2_000_000 // UNIT} * {total} + ({n} + {PRIOR}) * {2 * _SHIFT + 1}) DIV (2 * ({n} + {PRIOR})) - {_SHIFT})"


def _looked_up(k: np.ndarray, own: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where it isn't among own, which is sorted but for a last row that stands for none.

    The keys are sorted first, so that each is looked up once and near the one before it.
    """
    code = (k.astype(np.uint64) << np.uint64(32)) | np.arange(len(k), dtype=np.uint64)
    code.sort()
    key = (code >> np.uint64(32)).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at = np.searchsorted(own[:-1], key[cut])
    out = np.empty(len(k), np.int64)
    out[code & np.uint64(0xFFFFFFFF)] = np.repeat(np.where(own[at] == key[cut], value[at], 0), np.diff(np.r_[cut, len(k)]))
    return out


def scored(docs: DataFrame, labels: DataFrame, name: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """docs with a column of their scores; ``most`` is the number of keys up to which the ratios are broadcast."""
    ratios = fit(docs, labels)
    if ratios.count() > most:
        return _scored_by_join(docs, ratios, name)
    got = ratios.toArrow()
    key, ratio = got["key"].to_numpy().astype(np.uint32), got["ratio"].to_numpy()
    order = np.argsort(key, kind="stable")
    table = docs.sparkSession.sparkContext.broadcast((np.r_[key[order], np.uint32(0)], np.r_[ratio[order], 0].astype(np.int32)))

    def score(texts: pa.Array) -> pa.Array:
        give_back()
        own, value = table.value
        data, offs = utf8(texts)
        out = np.zeros(len(offs) - 1)
        for lo, _, part, cut in chunks(data, offs, GRAM_BYTES):
            k, seg = keys(part, cut)
            size = np.diff(seg)
            has = np.flatnonzero(size)
            if len(has):
                total = np.add.reduceat(_looked_up(k, own, value), seg[has])
                m = size[has] + PRIOR
                out[lo + has] = ((2_000_000 // UNIT * total + m) // (2 * m)) / 1e6
        return pa.array(out)

    return docs.withColumn(name, F.arrow_udf(score, "double")(text_of()))


def _scored_by_join(docs: DataFrame, ratios: DataFrame, name: str) -> DataFrame:
    """The same by a shuffled join of (document, key, n) with the ratios; partial sums are taken before the second shuffle."""
    numbered = materialize(docs.withColumn("__uid", F.monotonically_increasing_id()))

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            uid = b.column(0).to_numpy()
            for lo, hi, part, cut in chunks(data, offs):
                k, seg = keys(part, cut)
                size = np.diff(seg)
                row = np.repeat(np.arange(hi - lo, dtype=np.uint64), size)
                code, n = np.unique((row << np.uint64(32)) | k, return_counts=True)
                row = (code >> np.uint64(32)).astype(np.int64)
                for at in range(0, len(code), 1 << 16):
                    one = slice(at, at + (1 << 16))
                    cols = uid[lo:hi][row[one]], (code[one] & np.uint64(0xFFFFFFFF)).astype(np.int64), n[one], size[row[one]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["__uid", "key", "n", "grams"])

    counted = numbered.select("__uid", text_of().alias("__text")).mapInArrow(lean(run), "__uid long, key long, n long, grams long")
    total = counted.join(ratios, "key").groupBy("__uid").agg(F.sum(F.col("n") * F.col("ratio")).alias("__total"), F.first("grams").alias("__grams"))
    value = F.coalesce(F.expr(_micro("__total", "__grams")) / 1e6, F.lit(0.0))
    return numbered.join(total, "__uid", "left").withColumn(name, value).select(*docs.columns, name)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, score, keep) of every row of docs, repeated rows and null doc_ids included.

    A null text counts as an empty one. Texts of fewer than six bytes score 0. A score equal to the
    threshold is kept. Equal texts score alike. Without any trusted document every score is 0. Other
    columns are ignored.
    """
    names = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return scored(docs.select(names), labels, "score", most).select("doc_id", "score").withColumn("keep", F.col("score") >= threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; columns as given.

    A null, empty or very short text scores 0 and stays; rows of a null doc_id are scored like any
    other; repeated rows stay or go together; an empty table stays empty.
    """
    return scored(docs, labels, "__quality").filter(F.col("__quality") >= threshold).select(docs.columns)


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_scores`` of all documents by all labels, with the defaults; its cases are stated there."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SCORES_SQL = f"""
raw_docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, hex(encode(coalesce(text, ''))) AS hx FROM documents),
runs AS (SELECT rid, doc_id, lang, substr(hx, 2 * CAST(place AS BIGINT) + 1, {2 * (500 + GRAM - 1)}) AS hx FROM (SELECT *, unnest(range(0, length(hx) // 2, 500)) AS place FROM raw_docs)),
grams AS (
  SELECT rid, doc_id, lang, ((('0x' || substr(hx, 2 * CAST(i AS BIGINT) + 1, {2 * GRAM}))::UBIGINT::UHUGEINT * {_FACTOR}::UHUGEINT) % 18446744073709551616::UHUGEINT) // 4294967296 AS key, count(*) AS n
  FROM (SELECT rid, doc_id, lang, hx, unnest(range(0, length(hx) // 2 - {GRAM - 1})) AS i FROM runs) GROUP BY ALL),
counts AS (
  SELECT lang, key, sum(n) AS raw, coalesce(sum(n) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), 0) AS good FROM grams GROUP BY ALL),
langs AS (SELECT lang, sum(good)::DOUBLE / sum(raw) AS share FROM counts GROUP BY lang),
totals AS (SELECT sum(raw)::DOUBLE / nullif(sum(good), 0) AS scale FROM counts),
ratios AS (
  SELECT key, coalesce(round({UNIT} * (ln(sum(good) * scale + {PSEUDO}) - ln(sum(raw * share) * scale + {PSEUDO}))), 0)::BIGINT AS ratio
  FROM counts JOIN langs USING (lang), totals GROUP BY key, scale),
scored AS (
  SELECT r.rid, r.doc_id, coalesce(s.micro, 0) / 1e6::DOUBLE AS score FROM raw_docs r LEFT JOIN (
    SELECT rid, {_micro("sum(n * ratio)::BIGINT", "sum(n)::BIGINT").replace("DIV", "//")} AS micro FROM grams JOIN ratios USING (key) GROUP BY rid) s USING (rid))"""
SQL = f"WITH {SCORES_SQL} SELECT doc_id, score, score >= {THRESHOLD} AS keep FROM scored"
