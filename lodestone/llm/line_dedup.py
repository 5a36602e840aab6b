"""Line dedup with a fixed-depth log-template tree.

A line's tokens are its runs without white space; a token that holds a digit is a variable field
and masked. The tree's leaf for a line is its token count and its first ``DEPTH`` masked tokens.
Within a leaf a line joins the template with which it agrees in the largest share of positions, if
that is at least ``SIMILARITY``; positions that disagree become wildcards, which agree with nothing
more. Otherwise it starts a template. Lines are taken in the order of their 64-bit hashes.

A template that occurs in at least ``MIN_DOCS`` documents recurs: its lines are dropped from all
documents but the one of lowest doc_id that has it, so that a text that was copied stays once.

Only distinct masked lines of leaves that could recur and that hold more than one distinct line
are clustered; the rest is decided by counting. A template agrees with a line in at most as many
positions as each of its members does, so lines that can't share enough positions are put apart
beforehand: with at most d differing positions, one of d + 1 blocks must be equal. Leaves of more than
``BIG_LEAF`` distinct lines are split into such parts before the shuffle, by connected components of
(line, block) over all executors, so that a hot leaf, like that of all numeric table rows of one width,
isn't one task; smaller leaves are split within their task. The templates are the same either way.

Documents are told apart by doc_id. Whole copies may be given as groups that count as one document: a
line that only copies of one text have doesn't recur, and near copies keep the same lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.near_dedup import components
from lodestone.llm.shared import chunks, join_small, lean, materialize, mix64, segments, sorted_groups, text_of, tokens, utf8

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.8, 5
#: Distinct lines that one task clusters before they are split by components beforehand.
BIG_LEAF = 100_000
_NO_ID = (1 << 63) - 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FOLD = np.uint64(0x9FB21C651E98DF25)


def line_tokens(data: np.ndarray, offs: np.ndarray):
    """Row and number of each line that has a token, offsets of its tokens, and the masked tokens' hashes (0: variable)."""
    starts, ends, h = tokens(data, offs, solid=True)
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    h[digits[ends] > digits[starts]] = 0
    newline = np.flatnonzero(data == 10)
    row = np.searchsorted(offs, starts, side="right") - 1
    before = np.searchsorted(newline, starts)
    number = before - np.searchsorted(newline, offs[:-1])[row]
    if not len(row):
        return row, number, np.zeros(1, np.int64), h
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])])
    return row[cut], number[cut], np.r_[cut, len(h)], h


def line_keys(h: np.ndarray, cut: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit leaf key and line hash of each line."""
    size = np.diff(cut)
    leaf = size.astype(np.uint64)
    for j in range(depth):
        has = size > j
        leaf[has] = mix64(leaf[has] * _FOLD + h[cut[:-1][has] + j])
    place = np.arange(len(h)) - np.repeat(cut[:-1], size)
    line = mix64(np.add.reduceat(mix64(h + (place.astype(np.uint64) + np.uint64(1)) * _FOLD), cut[:-1]) + leaf) if len(size) else leaf
    return leaf.view(np.int64), line.view(np.int64)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(leaf, line, n, rk, doc, number) for each line that has a token; rk stands for the row's doc_id and text."""

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            rk, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, part, off in chunks(data, offs):
                row, number, cut, h = line_tokens(part, off)
                if len(row):
                    leaf, line = line_keys(h, cut, depth)
                    cols = [leaf, line, np.diff(cut).astype(np.int32), rk[lo + row], doc[lo + row], number.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["leaf", "line", "n", "rk", "doc", "number"])

    return _keyed(docs).select("__rk", "__doc", text_of().alias("__text")).mapInArrow(lean(run), "leaf long, line long, n int, rk long, doc long, number int")


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.withColumns({"__doc": doc, "__rk": F.xxhash64(doc, text_of())})


def cluster(lines: np.ndarray, similarity: float, depth: int) -> np.ndarray:
    """Template number of each row of a leaf's token matrix, rows taken in order."""
    n, length = lines.shape
    apart = _apart(lines, similarity, depth) if n > 32 else np.zeros(n, np.int64)
    out = np.full(n, -1, np.int64)
    order = np.argsort(apart, kind="stable")
    cut = np.r_[np.flatnonzero(np.r_[True, np.diff(apart[order]) != 0]), n]
    made = 0
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        rows = order[lo:hi]
        templates = np.zeros((min(8, len(rows)), length), lines.dtype)
        wild = np.zeros(templates.shape, bool)
        k = 0
        for r in rows:
            if k:
                same = ((templates[:k] == lines[r]) & ~wild[:k]).sum(axis=1)
                best = int(same.argmax())
                if same[best] >= similarity * length - 1e-9:
                    wild[best] |= templates[best] != lines[r]
                    out[r] = made + best
                    continue
            if k == len(templates):
                templates, wild = (np.concatenate([x, np.zeros_like(x)]) for x in (templates, wild))
            templates[k] = lines[r]
            out[r] = made + k
            k += 1
        made += k
    return out


def _apart(lines: np.ndarray, similarity: float, depth: int) -> np.ndarray:
    """Component of each row, where rows that have one of the blocks in common are connected."""
    n, length = lines.shape
    blocks = int((1 - similarity) * length + 1e-9) + 1
    rest = np.arange(min(depth, length), length)
    if blocks > len(rest):
        return np.zeros(n, np.int64)
    root = np.arange(n)
    while True:
        before = root.copy()
        for cols in np.array_split(rest, blocks):
            key = np.zeros(n, np.uint64)
            for c in cols:
                key = mix64(key * _FOLD + lines[:, c].astype(np.uint64))
            _, at = np.unique(key, return_inverse=True)
            low = np.full(at.max() + 1, n)
            np.minimum.at(low, at, root)
            root = np.minimum(root, low[at])
            root = root[root]
        if (root == before).all():
            return root


def _parts(rows: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(id, root): the component of each line of (leaf, line, h) that shares a block with another one."""

    def blocks(batches):
        for b in batches:
            line, hs = b.column(1).to_numpy(), b.column(2)
            offs, values = hs.offsets.to_numpy(), hs.values.to_numpy().view(np.uint64)
            leaf, width = b.column(0).to_numpy().view(np.uint64), np.diff(offs)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                m = values[offs[at][:, None] + np.arange(w)]
                rest, count = np.arange(min(depth, w), w), int((1 - similarity) * w + 1e-9) + 1
                for i, cols in enumerate(np.array_split(rest, count) if count <= len(rest) else [[]]):
                    key = mix64(leaf[at] + np.uint64(i + 1) * _FOLD)
                    for c in cols:
                        key = mix64(key * _FOLD + m[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line[at])], ["key", "line"])

    keyed = materialize(rows.mapInArrow(lean(blocks), "key long, line long").distinct())
    head = keyed.groupBy("key").agg(F.min("line").alias("head"))
    return components(keyed.join(head, "key").filter("line <> head").select(F.col("head").alias("a"), F.col("line").alias("b")))


def recurring(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, copies: DataFrame | None = None, big: int = BIG_LEAF) -> tuple[DataFrame, DataFrame]:
    """All lines, and (line, template, docs, first) of the lines of recurring templates."""
    lines = _lines(docs, depth)
    if copies is not None:
        groups = materialize(copies.select(F.col("doc_id").alias("doc"), F.col("group_id").alias("__group")))
        lines = join_small(lines, groups, "doc", "left").select("leaf", "line", "n", "rk", F.coalesce("__group", "doc").alias("doc"), "number")
    lines = materialize(lines)
    who = F.when(F.col("doc") == _NO_ID, F.col("rk")).otherwise(F.col("doc"))
    per_line = lines.groupBy("leaf", "line", "n").agg(F.count_distinct(who).alias("docs"), F.min("doc").alias("first"), F.min(F.struct("rk", "number")).alias("at"))
    leaf = per_line.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("kinds"))
    open_ = materialize(per_line.join(leaf.filter(F.col("leaf_docs") >= min_docs), "leaf"))
    sure = open_.filter((F.col("kinds") == 1) | (F.col("n") <= depth)).filter(F.col("docs") >= min_docs).select("line", F.col("line").alias("template"), "docs", "first")
    contested = open_.filter((F.col("kinds") > 1) & (F.col("n") > depth))
    where = contested.groupBy(F.col("at.rk").alias("__rk")).agg(F.sort_array(F.collect_list("at.number")).alias("__numbers"))

    def fetch(batches):
        for b in batches:
            data, offs = utf8(b.column(0))
            wanted = b.column(1)
            w_offs, w_values = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            for lo, hi, part, off in chunks(data, offs):
                row, number, cut, h = line_tokens(part, off)
                want = np.zeros(len(row), bool)
                seg = segments(row, hi - lo)
                for r in range(hi - lo):
                    want[seg[r] : seg[r + 1]] = np.isin(number[seg[r] : seg[r + 1]], w_values[w_offs[lo + r] : w_offs[lo + r + 1]])
                if want.any():
                    leaf, line = line_keys(h, cut, depth)
                    size = np.diff(cut)
                    values = h[np.repeat(want, size)].view(np.int64)
                    ends = np.r_[0, np.cumsum(size[want])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[want]), pa.array(line[want]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["leaf", "line", "h"])

    rows = _keyed(docs).select("__rk", text_of().alias("__text"))
    token_rows = join_small(rows, where, "__rk", "inner").select("__text", "__numbers").mapInArrow(lean(fetch), "leaf long, line long, h array<long>")
    hot = materialize(leaf.filter((F.col("leaf_docs") >= min_docs) & (F.col("kinds") > big)).select(F.col("leaf")))
    if not hot.isEmpty():
        marked = materialize(join_small(token_rows, hot.withColumn("hot", F.lit(True)), "leaf", "left"))
        parts = _parts(marked.filter("hot").select("leaf", "line", "h"), similarity, depth)
        split = join_small(marked.filter("hot"), parts.withColumnRenamed("id", "line"), "line", "left")
        token_rows = marked.filter("hot IS NULL").select("leaf", "line", "h").unionByName(split.select(F.xxhash64("leaf", F.coalesce("root", "line")).alias("leaf"), "line", "h"))

    def grow(batches):
        for t in sorted_groups(batches):
            leaf, line = t.column(0).to_numpy(), t.column(1).to_numpy()
            hs = t.column(2).combine_chunks()
            offs, values = hs.offsets.to_numpy(), hs.values.to_numpy()
            cut = np.r_[np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), len(leaf)]
            template = np.empty(len(leaf), np.int64)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                distinct, first = np.unique(line[lo:hi], return_index=True)
                width = offs[lo + 1] - offs[lo]
                m = values[(offs[lo + first][:, None] + np.arange(width)[None, :])]
                no = cluster(m, similarity, depth)
                head = np.full(no.max() + 1, -1, np.int64)
                for i in range(len(no) - 1, -1, -1):
                    head[no[i]] = distinct[i]
                template[lo:hi] = head[no][np.searchsorted(distinct, line[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(template)], ["line", "template"])

    grown = materialize(token_rows.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(lean(grow), "line long, template long").distinct())
    alone = grown.join(grown.groupBy("template").count().filter("count > 1").select("template"), "template")
    many = lines.select("line", "rk", "doc").join(alone, "line").groupBy("template").agg(F.count_distinct(who).alias("docs"), F.min("doc").alias("first")).filter(F.col("docs") >= min_docs)
    single = contested.select("line", "docs", "first").join(alone.select("line"), "line", "left_anti").filter(F.col("docs") >= min_docs)
    found = sure.unionByName(alone.join(many, "template").select("line", "template", "docs", "first")).unionByName(single.select("line", F.col("line").alias("template"), "docs", "first"))
    return lines, materialize(found)


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, dropped: str | None = None, copies: DataFrame | None = None, keep_emptied: bool = True) -> DataFrame:
    """docs with the lines of recurring templates taken out of text; n_chars, if there, follows.

    Every row stays, also one that loses all its lines, whose text is then empty, unless such rows are
    not to be kept. Lines without a token stay. A null text stays null. Rows with a null doc_id count as
    documents, told apart by their text, and come last in order. Rows that repeat a doc_id are one
    document; equal rows are treated alike. ``dropped`` names a column for the number of lines taken
    out. ``copies`` (doc_id, group_id) are groups of documents that count as one, that of group_id.
    """
    lines, found = recurring(docs, depth, similarity, min_docs, copies)
    gone = lines.join(found.select("line", "first"), "line").filter("doc <> first")
    per_row = materialize(gone.groupBy(F.col("rk").alias("__rk")).agg(F.sort_array(F.collect_set("number")).alias("__gone")))
    out = join_small(_keyed(docs), per_row, "__rk", "left", per_row.agg(F.coalesce(F.sum(F.size("__gone") + 2), F.lit(0))).first()[0])
    kept = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    if dropped:
        columns[dropped] = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    if not keep_emptied:
        out = out.filter(F.col("__gone").isNull() | (F.trim(F.regexp_replace(kept, r"\s+", " ")) != ""))
    return out.select([c.alias(k) for k, c in columns.items()])


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text without recurring lines, lines_dropped) of every document."""
    return drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), dropped="lines_dropped")
