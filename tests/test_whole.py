"""The registered queries do the whole job: nothing is cut off by a limit."""

import itertools
import random

from lodestone.plans import queries


def _save(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_lsh_finds_pairs_of_half(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = []
    for i in range(60):
        words = [word() for _ in range(120)]
        changed = list(words)
        for at in rng.sample(range(120), 2 + i % 18):  # similarities from about 0.55 to 0.95
            changed[at] = word()
        texts += [" ".join(words), " ".join(changed)]
    _save(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    true = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    low = {(a, b) for a, b in true if len(sets[a] & sets[b]) < 0.75 * len(sets[a] | sets[b])}
    assert len(low) >= 20
    got = [(r.a, r.b) for r in queries.QUERIES["sim05_lsh"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and len(true & set(got)) >= 0.9 * len(true)


def test_itemsets_of_every_level(spark, tmp_path):
    baskets = [[1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 6], [1, 2, 7]] + [[100 + i] for i in range(997)]
    _save(spark.createDataFrame([(b, i) for b, items in enumerate(baskets) for i in items], "l_orderkey long, l_suppkey long"), tmp_path, "lineitem")
    want = {}
    for n in range(1, 6):
        for c in itertools.combinations(range(1, 8), n):
            if (freq := sum(set(c) <= set(b) for b in baskets)) > 1:
                want[" ".join(map(str, c))] = freq
    got = {r.itemset: r.freq for r in queries.QUERIES["fim05_itemsets_all"](spark, str(tmp_path)).collect()}
    assert got == want and "1 2 3 4 5" in got
    rules = {(r.lhs, r.rhs): r.confidence for r in queries.QUERIES["fim06_rules_all"](spark, str(tmp_path)).collect()}
    assert rules["1 2 3 4", 5] == 1.0 and rules["1 2", 3] == 0.666667 and rules["1 2 3 4 5", 6] == 0.5


def test_jaccard_of_documents(spark, tmp_path):
    texts = ["The quick brown fox jumps", "the quick brown fox jumped", "Nothing of it", "", "abc", "quick brown bears of it", "The quick brown fox jumps"]
    _save(spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string"), tmp_path, "documents")
    sets = [{t[i : i + 5].lower() for i in range(len(t) - 4)} for t in texts]
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] & sets[b]}
    assert (0, 6, 1.0) in want
    assert {tuple(r) for r in queries.QUERIES["sim03_jaccard_documents"](spark, str(tmp_path)).collect()} == want
