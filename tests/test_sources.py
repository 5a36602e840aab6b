"""Readers and writers of text formats."""

from lodestone.operators import index
from lodestone.sources import files


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    put("d/a/x.txt", "one\ntwo")
    put("d/y.txt", "three")
    assert sorted(r.text for r in files.text_documents(spark, str(tmp_path / "d")).collect()) == ["one\ntwo", "three"]
    assert sorted(map(tuple, files.link_file(spark, put("links", "0;1,2,\n1;2,2,\n2;\n")).collect())) == [("0", "1"), ("0", "2"), ("1", "2")]
    assert sorted((r.basket, r.item) for r in files.baskets(spark, put("b", "3 1 3 \n7\n")).collect()) == [(0, 1), (0, 3), (1, 7)]
    assert sorted(map(tuple, files.edge_list(spark, put("e", "# c\n1\t2\n2\t2\n3\t1\n")).collect())) == [(1, 2), (3, 1)]
    assert sorted(map(tuple, files.metis_graph(spark, put("m", "% c\n3 2\n2 3\n1\n1\n")).collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)]
    assert files.patterns(put("p", "// no\n\\d+\n\n")) == ["\\d+"]
    put("runs/r1", "# a\nround cut\n0\t9\t0\n1\t5\t0\n")
    put("runs/r2", "0\t9\t0\n1\t6\t0\n")
    best = files.best_run(spark, str(tmp_path / "runs")).first()
    assert best.edge_cut == 5 and best.file.endswith("r1")


def test_writers(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.25), (2, 0.5)], "id long, rank double")
    files.write_top(scores, str(tmp_path / "top"), k=1)
    assert spark.read.text(str(tmp_path / "top")).first()[0] == "2: 0.50000"
    postings = index.postings(index.tokens(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")))
    assert sorted(map(str, files.parse_postings(files.posting_lines(postings)).collect())) == sorted(map(str, postings.collect()))
