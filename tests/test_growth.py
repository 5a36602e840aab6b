"""Steps whose cost must follow the input: what they shuffle or compare, held against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import agents, events, graphs, index, learn, search, similar
from lodestone.plans import queries, ranges


def plan(df):
    return df._jdf.queryExecution().toString()


def most_rows(df):
    """The most rows that a node of the executed plan gave."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def _save(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_sets_meet_by_both_keys(spark, tmp_path):
    orders = [*range(0, 1500, 50), 7, 107, 408, 508, -50, 50]
    _save(spark.createDataFrame([(o, (o * k) % 11) for o in orders for k in (1, 3)], "l_orderkey long, l_suppkey long"), tmp_path, "lineitem")
    got = queries.QUERIES["sim04_jaccard_of_sets"](spark, str(tmp_path))
    same = lambda a, b: abs(a) % 100 == abs(b) % 100 and (a < 0) == (b < 0)
    want = {(a, b) for a in orders for b in orders if a < b <= a + 300 and same(a, b)}
    assert {(r.a, r.b) for r in got.collect()} == want and (7, 107) in want and (-50, 50) not in want
    assert "(b - a)" not in plan(got) and "+ 300" in plan(got)  # an equi-join on the other set's key, not on g alone


def test_shingles_are_counted_in_place(spark, tmp_path):
    rng = random.Random(4)
    wide = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(9000))  # more characters than five of them fit a number
    texts = ["Abcdeabcde", "abcd", "", None, "ÀÉîõüàéÎÕÜx", "a😀bc😀bc😀b", wide + wide, *("".join(rng.choices("abAB ", k=rng.randint(0, 60))) for _ in range(60))]
    docs = spark.createDataFrame([*enumerate(texts), (0, "abcdef")], "doc_id long, text string")
    _save(docs, tmp_path, "documents")
    want = sorted((i, len({t[j : j + 5].lower() for j in range(len(t) - 4)})) for i, t in [*enumerate(texts), (0, "abcdef")] if t and len(t) > 4)
    found = queries.QUERIES["sim01_shingles"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == want and "Exchange" not in plan(found)
    assert sorted(map(tuple, similar.shingle_counts(docs, step=50).collect())) == want


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    for rows in (rng.normal(size=(260, 7)) + 1e5, np.floor(rng.normal(size=(260, 3)) * 2), np.zeros((90, 2))):  # far off, many ties, all equal
        labels = rng.integers(0, 3, len(rows))
        df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(rows, labels, strict=True))] + [(-1, None, 1), (-2, [1.0], 2)], "vec_id long, embedding array<double>, label int")
        far = np.zeros((len(rows), len(rows)))
        for d in range(rows.shape[1]):
            far += (rows[None, :, d] - rows[:, None, d]) ** 2
        np.fill_diagonal(far, np.inf)
        for k in (1, 3):
            want = {}
            for i, f in enumerate(far):
                near = labels[np.lexsort((np.arange(len(rows)), f))[:k]].tolist()
                want[i] = max(near, key=lambda c, near=near: (near.count(c), -near.index(c)))
            found = learn.knn(df, df, k)
            assert {r.vec_id: r.prediction for r in found.collect()} == want
    assert "REPARTITION_BY_NUM" in plan(found)  # blocks are small but much work: they aren't put together into one task


def test_scenes_are_chosen_row_by_row(spark):
    guests = spark.range(200).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    scenes = [(i, float(i % 5), float(i % 3)) for i in range(30)]
    held = spark.createDataFrame(scenes, "id long, a double, b double")
    found = agents.best_scene(guests, held, ["a", "b"])
    for g in found.collect():
        assert (g.utility, -g.scene) == max((g.guest % 7 * a + g.guest % 11 * b, -i) for i, a, b in scenes)
    assert most_rows(found) <= 200  # not one for each guest and scene
    assert agents.best_scene(guests, held.limit(0), ["a", "b"]).count() == 0
    twice = agents.best_scene(guests.unionByName(guests.withColumn("a", F.col("a") + 100)), held, ["a", "b"])
    assert twice.count() == 200 and twice.filter("guest = 8").first().utility == 101 * 4 + 8 * 2


def _crowd(spark, seed):
    rng = random.Random(seed)
    one = lambda n, span: [(i, float(rng.randrange(span)), rng.random() * span) for i in range(n)]
    left, right = one(300, 60), [*one(400, 60), (400, None, 1.0), (401, float("nan"), 1.0)]
    near = [(a, b) for a, x, y in left for b, u, v in right if u is not None and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 < 9]
    return spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "id long, x double, y double"), near


def test_crowded_cells_are_split(spark, monkeypatch):
    left, right, near = _crowd(spark, 3)
    monkeypatch.setattr(agents, "PAIR_CELL", (5, 8))
    found = agents.within(left, right, 9.0)
    got = [(r.l_id, r.r_id) for r in found.collect()]
    assert sorted(got) == sorted(near) and "REPARTITION_BY_NUM" in plan(found)


def test_traits_are_counted_without_pairs(spark, monkeypatch):
    left, right, near = _crowd(spark, 1)
    right = right.withColumn("kind", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)))
    want = {}
    for a, b in near:
        key = a, f"k{b % 3}" if b % 3 else None
        want[key] = want.get(key, 0) + 1
    for most in (agents.COUNT_CELL, (7, 11)):
        monkeypatch.setattr(agents, "COUNT_CELL", most)
        found = agents.trait_counts_within(left, right, 9.0, "kind")
        assert {(r.l_id, r.trait): r.n for r in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in plan(queries.QUERIES["agt03_trait_counts"](spark, "/root/testdata/sf0.001"))


def test_beliefs_without_pairs(spark):
    left, right, near = _crowd(spark, 2)
    kind = F.when(F.col("id") % 4 == 0, "food").when(F.col("id") % 4 == 1, "music")
    got = agents.perceived(left, right, 9.0, kind)
    assert {tuple(r) for r in got.collect()} == {(a, ("food", "music")[b % 4]) for a, b in near if b % 4 < 2}
    free = agents.without_caught(left, left.filter("id % 2 = 0"), right, 9.0)
    caught = {a for a, _ in near if a % 2 == 0}
    assert {r.id for r in free.collect()} == set(range(300)) - caught
    assert "FlatMapCoGroupsInArrow" in plan(got) and "FlatMapCoGroupsInArrow" in plan(free)


def test_busy_nodes_are_several_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", f"n{i % 9}"]), rng.choice([None, *range(50)])) for i in rng.sample(range(400), 400)]
    df = spark.createDataFrame(rows, "i long, k string, v long")
    want = {}
    for i, k, v in sorted(rows):
        n, least = next(((n, m) for _, kk, n, m in reversed(list(want.values())) if kk == k), (-1, None))
        want[i] = i, k, n + 1, min((x for x in (least, v) if x is not None), default=None)
    least = ranges.running(df, [F.col("i")], {"least": ("min", F.col("v"))}, within=F.col("k"))
    got = ranges.numbered(least, "n", F.col("i"), within=F.col("k")).select("i", "k", "n", "least")
    assert {r.i: tuple(r) for r in got.collect()} == want
    log = spark.createDataFrame([(i, "ab"[i % 2], {"ab"[i % 2]: i // 2 + 1}) for i in range(100)], "arrival long, node string, clock map<string,long>")
    released = events.vector_release(log)
    assert all(r.released_at == r.arrival for r in released.collect()) and "windowspecdefinition(k" not in plan(released)


def _texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["the", "a", "b", "ö", "w1", f"x{i % 7}"], k=rng.randint(0, 30)))) for i in range(n)]


def test_postings_are_made_in_blocks(spark):
    docs = spark.createDataFrame([*_texts(80, 1), (90, None), (91, "")], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, index.postings(index.tokens(docs)).collect()))
    for step in (1, 100, index.ROW_WORDS):
        found = index.row_postings(docs, step=step).drop("n_words").collect()
        assert sorted(map(str, found)) == want
    assert [r.term.encode() for r in found] == sorted(r.term.encode() for r in found)  # one block


def test_index_is_stored_without_a_shuffle_of_postings(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(80, 2), "doc_id long, text string")
    plain = search.Index.of(docs)
    for hot in (1, index.HOT_TERMS):
        monkeypatch.setattr(index, "HOT_TERMS", hot)
        store = index.write_index(docs, runs=2)
        held = search.Index.stored(store)
        both = lambda name, *c: [sorted(map(str, getattr(x, name).select(*c).collect())) for x in (plain, held)]  # noqa: E731, B023
        for name, *c in (("postings", "term", "doc_id", "tf", "positions"), ("terms", "term", "df"), ("words", "doc_id", "n_words"), ("kgrams", "kgram", "term"), ("weights", "doc_id", "term", "tf", "df", "w")):
            one, other = both(name, *c)
            assert one == other, name
        assert {r.doc_id: round(r.euclid, 9) for r in plain.sizes.collect()} == {r.doc_id: round(r.euclid, 9) for r in held.sizes.collect()}
    assert not store._merged()  # the runs are the index: no posting was written twice
    store.add_run(2, spark.createDataFrame([(3, "new the"), (99, "new")], "doc_id long, text string"))
    store.merge(docs.select("doc_id").unionByName(spark.createDataFrame([(3,), (99,)], "doc_id long")))
    assert {r.doc_id for r in index.lookup(store.read("postings"), ["new"]).collect()} == {3, 99} and store._merged()
    assert search.Index.stored(store).sizes.count() == sum(bool(t) for _, t in _texts(80, 2)) + 1


def test_merge_check_compares_documents_first(spark):
    docs = spark.createDataFrame(_texts(40, 3), "doc_id long, text string")
    whole = index.row_postings(docs).drop("n_words")
    found = index.merge_check(whole, index.postings(index.tokens(docs)))
    assert tuple(found.first()) == (0, 0) and "Exchange" not in plan(found)  # nothing is left to compare
    other = whole.filter("doc_id <> 5").unionByName(whole.filter("doc_id = 7 AND term = 'the'")).withColumn("positions", F.when(F.col("doc_id") == 9, F.array(F.lit(1))).otherwise(F.col("positions")))
    a, b = other.collect(), whole.collect()
    a, b = (Counter(map(str, x)) for x in (a, b))
    assert tuple(index.merge_check(other, whole).first()) == ((b - a).total(), (a - b).total())
    halves = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").unionByName(docs.filter("doc_id = 4").withColumn("text", F.lit("the last")))
    parts = [index.row_postings(h).drop("n_words") for h in halves]
    twice = index.repeated(halves[0].unionByName(halves[1]))
    one, other = index.merge_postings(*parts), index.merge_postings(*parts, twice)
    assert [r.doc_id for r in twice.collect()] == [4] and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_triangles_without_wedges(spark, monkeypatch):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(-20, 60), 2))) for _ in range(700)} | {(100, i) for i in range(-20, 60)} | {(7_000_000_000, i) for i in range(9)}
    pairs = {tuple(sorted(p)) for p in pairs}
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
    want = sum(len(of[a] & of.get(b, set())) for a, b in pairs)
    edges = spark.createDataFrame([*pairs, (5, 5), *[(b, a) for a, b in list(pairs)[:50]]], "src long, dst long")
    for block, step in ((graphs.TRIANGLE_BLOCK, graphs.TRIANGLE_STEP), (50, 7)):
        monkeypatch.setattr(graphs, "TRIANGLE_BLOCK", block)
        monkeypatch.setattr(graphs, "TRIANGLE_STEP", step)
        found = graphs.triangles(edges)
        assert found.first().triangles == want
    assert "x < y" not in plan(found) and most_rows(found) <= 8 * len(pairs)
    assert tuple(graphs.triangles(edges.limit(0)).first()) == (0, 0, None)


def test_clusters_of_many_nodes(spark):
    rng = random.Random(9)
    groups = [range(k * 30, k * 30 + 30) for k in range(3)]
    pairs = [p for g in groups for p in {tuple(sorted(rng.sample(g, 2))) for _ in range(160)}] + [(0, 30), (31, 60), (61, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    small, large = (graphs.spectral_clusters(edges, 3, most=most, normalize="row").collect() for most in (5000, 10))
    parts = [{frozenset(r.id for r in found if r.cluster == c) for c in range(3)} for found in (small, large)]
    assert parts[0] == parts[1] == {frozenset(g) for g in groups}


def test_gains_by_one_join_for_each_end(spark):
    rng = random.Random(10)
    edges = graphs.affinity(spark.createDataFrame([tuple(rng.sample(range(40), 2)) for _ in range(150)], "src long, dst long"))
    colored = graphs.initial_parts(edges.select(F.col("src").alias("id")).distinct(), 3)
    nodes = graphs.node_degrees(edges, colored, 3)
    counted = {(r.id, r.color): r.degree for r in graphs.color_degrees(edges, colored).collect()}
    assert {(r.id, c): n for r in nodes.collect() for c, n in enumerate(r.degrees) if n} == counted
    pairs = edges.select(F.col("src").alias("p"), F.col("dst").alias("q"))
    one, other = graphs.exchange_gain(pairs, colored, graphs.color_degrees(edges, colored), 1.5), graphs.node_gain(pairs, nodes, 1.5)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert sorted(map(tuple, edges.collect())) == sorted({(b, a) for a, b in map(tuple, edges.collect())})
