"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, bpe, html, licenses, line_dedup, near_dedup, packing, pii, quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 30_000
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank while seven birds sing above"


def rows():
    texts = [None, "", " \n\t", "!?", "x", PROSE, PROSE, PROSE + " today", LONG, "mail me: jane@ex.com", "é漢字🎉 \0 tail\r\nnext"]
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, (None, PROSE, None, None, None), (None, None, None, None, None), (5, PROSE, "en", "s", len(PROSE)), (5, PROSE, "en", "s", len(PROSE))]


#: Names that the operators might use for themselves.
CLASH = ["score", "keep", "sig", "bands", "uid", "line", "rk", "doc", "leaf", "key", "ids", "kind", "severity", "toxic", "pack_id", "part", "host", "n_words", "class", "share", "__x"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), DOC)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (5, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_scores_cover_every_row(docs, none, labels, no_labels):
    for f in (quality.quality_scores, toxicity.score_toxicity):
        for lab in (labels, no_labels):
            assert f(docs, lab).count() == len(rows())
            assert f(none, lab).count() == 0
    got = quality.quality_scores(docs, no_labels).collect()
    assert all(r.score == 0 and r.keep for r in got)


def test_bpe(docs, none):
    got = bpe.encode_documents(docs).collect()
    assert len(got) == len(rows()) and bpe.encode_documents(none).count() == 0
    for r in got:
        if r.ids is None:
            assert r.n_tokens is None and r.round_trip is None
        else:
            assert r.round_trip and r.n_tokens == len(r.ids)


def test_bpe_columns_round_trip(docs, spark):
    ids = docs.select("text", bpe.encoded(spark).alias("tokens"))
    assert ids.select("text", bpe.decoded(spark, "tokens").alias("back")).filter("NOT (text <=> back)").count() == 0


def test_near_dedup(docs, none):
    got = {(r.doc_id, r.group_id, r.keep) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (6, 5, False), (7, 5, False)}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10] and ids.count(None) == 2
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, 64, 16).collect()
    assert sum(r.n_words for r in got) == sum(len((r[1] or "").split()) for r in rows())
    used, places = {}, set()
    for r in got:
        used[r.pack_id] = used.get(r.pack_id, 0) + r.n_words
        places.add((r.pack_id, r.place))
    assert max(used.values()) <= 64 and len(places) == len(got)
    assert packing.pack_documents(none).count() == 0 and packing.pack_texts(none).count() == 0
    text = {}
    for r in packing.pack_texts(docs, 64, 16).filter("doc_id = 8").collect():
        assert len(r.text.split()) == r.n_words
        text[r.part] = r.text
    assert "".join(text[i] for i in sorted(text)) == LONG


def test_licenses(docs, none):
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(none).count() == 0
    two = docs.sparkSession.createDataFrame([(None, "é Released under the MIT License. And: Released under the MIT License.")] * 2, "doc_id long, text string")
    got = licenses.scan_licenses(two).collect()
    assert sorted((r.license, r.coverage, r.start, r.end) for r in got) == [("MIT-short", 1.0, 2, 32), ("MIT-short", 1.0, 2, 32), ("MIT-short", 1.0, 39, 69), ("MIT-short", 1.0, 39, 69)]


def test_pii(docs, none):
    got = pii.find_pii(docs).collect()
    assert [(r.doc_id, r.kind, r.start, r.end, r.value) for r in got] == [(9, "EMAIL", 9, 20, "jane@ex.com")]
    out = pii.mask_pii(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    r = out.filter("doc_id = 9").first()
    assert (r.text, r.n_chars) == ("mail me: <EMAIL>", 16)
    assert out.filter("text IS NULL").count() == 2 and pii.find_pii(none).count() == 0


def test_neighbours(spark):
    base = [(i, [float(i % 7), float(i % 5), 1.0, 0.0]) for i in range(40)]
    bad = [(None, [1.0] * 4), (50, None), (51, []), (52, [float("nan")] * 4), (53, [1.0]), (3, [3.0, 3.0, 1.0, 0.0]), (54, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(base + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "vec", "list", "home", "grp", "q", "v")})
    got = ann.neighbours(df, k=3, every=1).collect()
    assert {r.vec_id for r in got} == set(range(40)) and len(got) == 120
    first = min((r for r in got if r.vec_id == 0), key=lambda r: r.rank)
    assert (first.neighbour, first.distance) == (35, 0.0)
    assert {r.vec_id for r in ann.neighbours(df, k=3, every=7).collect()} == set(range(0, 40, 7))
    assert ann.neighbours(df.limit(0)).count() == 0 and ann.neighbours(df.filter("vec_id = 1")).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.drop_recurring_lines(docs, dropped="gone")
    assert out.columns == [*docs.columns, "gone"] and out.count() == len(rows())
    assert out.filter("text IS NULL").count() == 2 and line_dedup.drop_recurring_lines(none).count() == 0


def test_html(spark):
    nav = "<nav>" + " ".join(f"nav{i}" for i in range(14)) + "</nav>"
    page = lambda i, body: (i, "http://H.example.com/a", f"<html><head><title>t</title></head><script>x<y</script>{nav}<p>{body} &amp; more</p></html>")
    data = [page(1, "one"), page(2, "two"), page(2, "two"), (3, None, nav), (4, None, nav), (5, "http://h.example.com", None), (6, "", ""), (None, "http://h.example.com/z", nav)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("key", "host", "text")})
    got = html.unique_text(df).collect()
    assert len(got) == len(data)
    assert sorted(r.text for r in got if r.page_id in (1, 2)) == ["one & more", "two & more", "two & more"]
    assert [r.n_removed for r in got if r.page_id in (3, 4)] == [0, 0] and [r.text for r in got if r.page_id is None] == [""]
    assert html.unique_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, docs, none, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        out = stage(spark, table, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table.columns
        out.count()


def test_empty_batches():
    assert packing.plan(packing.np.zeros(17, int)) == [] and licenses.Index({}).keys.size == 0
    assert html.unique_runs(pa.array([], pa.string()), packing.np.zeros(0, int))[0] == []


def test_scores_of_ties_nulls_and_repeats(docs, labels):
    got = quality.quality_scores(docs, labels).collect()
    by_text = {}
    for r, (_, text, *_rest) in zip(got, rows(), strict=True):
        by_text.setdefault(text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values()) and by_text[""] == {0.0} and by_text["x"] == {0.0}
    least = min(r.score for r in got)
    assert quality.keep_quality(docs, labels, least).count() == len(rows())  # a score at the threshold stays
    kept = quality.keep_quality(docs, labels, least + 1e-6)
    assert kept.columns == docs.columns and kept.count() == sum(r.score > least for r in got) < len(rows())
    severe = toxicity.score_toxicity(docs, labels).collect()
    assert len({r.severity for r, (_, text, *_rest) in zip(severe, rows(), strict=True) if text == PROSE}) == 1
    assert all(r.toxic == (r.severity >= toxicity.THRESHOLD) for r in severe)


def test_lines_of_rows_without_an_id(spark):
    line = "the same line in all of them"
    data = [(i, f"{line}\nown {'abcde'[i]}") for i in range(4)] + [(None, f"{line}\nlast"), (None, f"{line}\nlast"), (3, f"{line}\nown d")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.drop_recurring_lines(df).collect())
    # four documents and one without an id have the line, which is enough; the first keeps it, equal rows are alike
    assert out == [(False, 0, f"{line}\nown a"), (False, 1, "own b"), (False, 2, "own c"), (False, 3, "own d"), (False, 3, "own d"), (True, 0, "last"), (True, 0, "last")]


def test_stages_keep_what_they_say(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    assert texts(stages["quality_rules"](spark, docs, str(tmp_path))) == texts(docs)
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lines.count() == len(rows()) and lines.filter("text IS NULL").count() == 2
    once = stages["near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10] and sum(r.doc_id is None for r in once) == 2
    masked = stages["pii"](spark, docs, str(tmp_path))
    assert masked.filter("doc_id = 9").first().text == "mail me: <EMAIL>" and masked.count() == len(rows())
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {3, 4, 5, 6, 7, 8, 9, 10, None}
    for i in (3, 4, 9):
        assert [r.text for r in packed if r.doc_id == i] == [dict((x[0], x[1]) for x in rows())[i]]


def test_html_of_a_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, "http://h.com/a", f"<p>{words}</p>"), (2, "http://h.com/b", f"<p>{words} end</p>"), (3, "http://h.com/c", "<p>short</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_tokens, r.n_removed) for r in html.unique_text(df).collect()}
    assert got == {1: ("", 200_000, 200_000), 2: ("end", 200_001, 200_000), 3: ("short", 1, 0)}
