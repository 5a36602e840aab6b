"""Pattern packing of documents into sequences by non-negative least squares.

A document's length is its number of words; one longer than ``CAPACITY`` is cut into full pieces and
a rest, so that every word is kept. Lengths are rounded up to ``CLASSES`` classes. All patterns of at
most ``PER_PATTERN`` classes that fill a sequence exactly are enumerated, repeat counts that
reproduce the histogram are fitted by non-negative least squares and rounded, and what the rounded
patterns leave of the histogram is packed best-fit, longest class first, into the tightest open room.

All of that happens on the histogram, whose size does not depend on the data. Pieces are then
numbered within their class, and a piece's number decides its pattern, its sequence and its place
there, by a table of slot ranges that does not grow with the data either.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import _SOLID, chunks, give_back, join_small, lean, materialize, owner, spans, text_of, utf8

#: Bytes of text that are handed on at a time.
PIECE_BYTES = 1 << 22
CAPACITY, CLASSES, PER_PATTERN = 2048, 128, 4
#: Pieces that one task numbers; a class with more is numbered by several, and offsets are added.
NUMBERED = 1_000_000


def patterns(classes: int, per: int) -> np.ndarray:
    """(patterns, per) class numbers in descending order, 0 for none, each row with the sum ``classes``."""
    rows = np.zeros((1, 0), np.int32)
    for left in range(per, 0, -1):
        room = classes - rows.sum(axis=1)
        top = np.minimum(room, rows[:, -1] if rows.shape[1] else classes)
        low = -(-room // left)  # the rest must still fit under this one
        n = np.maximum(top - low + 1, 0)
        at = np.repeat(np.arange(len(rows)), n)
        value = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
        rows = np.c_[rows[at], value.astype(np.int32)]
    return rows


def nnls(pats: np.ndarray, h: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - h|, by the active-set method; A's columns count a pattern's classes."""
    n = len(h) - 1  # h[0] is unused
    x = np.zeros(len(pats))
    passive: list[int] = []
    column = lambda p: np.bincount(pats[p], minlength=n + 1)[1:].astype(float)
    a = np.zeros((n, 0))
    target = h[1:].astype(float)
    tolerance = 1e-9 * max(1.0, target.max(initial=0) * n)
    for _ in range(rounds):
        rest = np.r_[0.0, target - a @ x[passive]]
        gain = rest[pats].sum(axis=1)
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        passive.append(best)
        a = np.c_[a, column(best)]
        while True:
            z = np.linalg.lstsq(a, target, rcond=None)[0]
            if z.min() > 0:
                x[passive] = z
                break
            now = x[passive]
            bad = z <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            now = now + step * (z - now)
            now[bad & (now <= 1e-12 * max(1.0, now.max()))] = 0
            if (now > 0).all():
                now[np.flatnonzero(bad)[np.argmin(now[bad])]] = 0
            x[passive] = now
            keep = now > 0
            a = a[:, keep]
            passive = [p for p, k in zip(passive, keep, strict=True) if k]
            if not passive:
                break
    return x


def plan(h: np.ndarray, per: int = PER_PATTERN) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, repeats) so that class c occurs h[c] times in all; sums never exceed the capacity."""
    classes = len(h) - 1
    left = h.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        pats = patterns(classes, per)
        x = nnls(pats, left)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 0.5:
                break
            used, times = np.unique(pats[p][pats[p] > 0], return_counts=True)
            n = int(min(np.rint(x[p]), (left[used] // times).min()))
            if n:
                left[used] -= n * times
                out.append((tuple(int(c) for c in pats[p] if c), n))
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left: sequences
    for c in range(classes, 0, -1):
        todo = int(left[c])
        while todo:
            room = min((r for r, seqs in open_.items() if r >= c and seqs), default=None)
            if room is None:
                # the class alone, as often as it fits
                fit = min(classes // c, todo)
                n = todo // fit
                seqs = open_[classes - fit * c]
                seqs[(c,) * fit] = seqs.get((c,) * fit, 0) + n
                todo -= n * fit
                continue
            seq, n = next(iter(open_[room].items()))
            fit = min(room // c, todo)
            n_used = min(n, todo // fit)
            if n_used == n:
                del open_[room][seq]
            else:
                open_[room][seq] = n - n_used
            new = (*seq, *(c,) * fit)
            open_[room - fit * c][new] = open_[room - fit * c].get(new, 0) + n_used
            todo -= n_used * fit
    return out + [(seq, n) for seqs in open_.values() for seq, n in seqs.items()]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first number, last number + 1, first sequence, place): which pieces of a class go where."""
    used: dict[int, int] = defaultdict(int)
    first, out = 0, []
    for seq, n in packs:
        for place, c in enumerate(seq):
            out.append((c, used[c], used[c] + n, first, place))
            used[c] += n
        first += n
    return out


def word_count(column: str = "text"):
    """Arrow UDF column: runs of characters other than ASCII white space."""

    def run(texts: pa.Array) -> pa.Array:
        give_back()
        data, offs = utf8(texts)
        out = np.zeros(len(offs) - 1, np.int64)
        for lo, hi, part, cut in chunks(data, offs):
            out[lo:hi] = np.bincount(owner(cut, spans(_SOLID[part], cut)[0]), minlength=hi - lo)
        return pa.array(out)

    return F.arrow_udf(run, "long")(text_of(column))


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, per: int = PER_PATTERN) -> DataFrame:
    """From (uid, doc_id, n_words), whose uids are distinct, to a row for each piece with its sequence and place.

    (uid, doc_id, part, first_word, n_words, pack_id, place): the piece covers n_words words from
    first_word. Documents without words have no row. The uid breaks ties, so the result is the same
    for the same table.
    """
    unit = -(-capacity // classes)
    if unit * classes != capacity:
        raise ValueError("capacity must be a multiple of classes")
    spark = lengths.sparkSession
    piece = F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n_words - 1) DIV {capacity} AS INT)"))).alias("part")
    pieces = lengths.filter("n_words > 0").select("uid", "doc_id", F.col("n_words").alias("total"), piece)
    pieces = pieces.select("uid", "doc_id", "part", (F.col("part").cast("long") * capacity).alias("first_word"), F.least(F.lit(capacity), F.col("total") - F.col("part") * capacity).cast("int").alias("n_words"))
    pieces = materialize(pieces.withColumn("class", F.expr(f"CAST((n_words + {unit - 1}) DIV {unit} AS INT)")))
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    h = np.zeros(classes + 1, np.int64)
    for c, n in counts.items():
        h[c] = n
    shares = int(h.sum()) // NUMBERED + 1
    salted = pieces.withColumn("share", F.pmod(F.xxhash64("uid", "part"), F.lit(shares)).cast("int"))
    sizes = salted.groupBy("class", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select(F.struct("class", "share").alias("__group"), F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("class", "share").orderBy("uid", "part")) - 1).withColumn("__group", F.struct("class", "share"))
    numbered = join_small(ranked, offset, "__group", "inner", shares * classes).withColumn("number", F.col("__rank") + F.col("__before"))
    table = slots(plan(h, per))
    slot = spark.createDataFrame(table, "__class int, __from long, __to long, __first long, place int").groupBy("__class").agg(F.sort_array(F.collect_list(F.struct("__from", "__to", "__first", "place"))).alias("__slots"))
    joined = numbered.join(F.broadcast(slot), numbered["class"] == F.col("__class"))
    hit = F.filter("__slots", lambda s: (s["__from"] <= F.col("number")) & (F.col("number") < s["__to"]))[0]
    return joined.withColumn("__hit", hit).select("uid", "doc_id", "part", "first_word", "n_words", (F.col("__hit.__first") + F.col("number") - F.col("__hit.__from")).alias("pack_id"), F.col("__hit.place").alias("place"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, per: int = PER_PATTERN) -> DataFrame:
    """(doc_id, part, first_word, n_words, pack_id, place) of every piece of every document with a word.

    Null and empty texts have no words and no row. A null doc_id is kept as null; rows that repeat a
    doc_id are packed each for itself. Other columns are ignored.
    """
    lengths = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_words")))
    return pack_lengths(lengths, capacity, classes, per).drop("uid")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, per: int = PER_PATTERN) -> DataFrame:
    """As pack_documents, with the piece's text: from its first word to before the next piece's.

    A text meets the list of its pieces once, so that a very long one is neither copied nor read again
    for each of them.
    """
    kept = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_words"), F.col("text").alias("__text")))
    packed = pack_lengths(kept.drop("__text"), capacity, classes, per)
    lists = materialize(packed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("part", F.col("pack_id").cast("long").alias("pack_id"), F.col("place").cast("int").alias("place"), "first_word", "n_words"))).alias("pieces")))
    whole = join_small(kept.select("uid", "doc_id", F.col("__text").alias("text")), lists, "uid", "inner", lists.agg(F.sum(F.size("pieces") + 1)).first()[0] or 0)

    def cut(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            lists = b.column(2)
            ends, fields = lists.offsets.to_numpy(), [lists.values.field(i).to_numpy() for i in range(5)]
            at, out, size = [], [], 0
            for i in range(b.num_rows):
                text = data[offs[i] : offs[i + 1]]
                raw, words = text.tobytes(), None
                for j in range(ends[i], ends[i + 1]):
                    lo, hi = 0, len(raw)
                    first, n = fields[3][j], fields[4][j]
                    if first > 0 or n == capacity:
                        words = spans(_SOLID[text], np.array([0, len(text)]))[0] if words is None else words
                        lo, hi = (0 if first == 0 else words[first]), (words[first + n] if first + n < len(words) else len(raw))
                    at.append((i, j))
                    out.append(raw[lo:hi].decode())
                    size += hi - lo
                    if size > PIECE_BYTES:
                        yield batch(b, fields, at, out)
                        at, out, size = [], [], 0
            if out:
                yield batch(b, fields, at, out)

    def batch(b, fields, at, out):
        row, own = (np.array(x) for x in zip(*at, strict=True))
        part, pack, place, first, n = (pa.array(f[own]) for f in fields)
        return pa.RecordBatch.from_arrays([pack, place, b.column(0).take(pa.array(row)), part, first, n, pa.array(out, pa.string())], ["pack_id", "place", "doc_id", "part", "first_word", "n_words", "text"])

    return whole.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "pieces").mapInArrow(lean(cut), "pack_id long, place int, doc_id long, part int, first_word long, n_words int, text string")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` of all documents, with the defaults; its cases are stated there."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
