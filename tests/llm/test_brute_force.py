"""Operators that SQL can't express, against brute force, exact round trips or held-out accuracy."""

import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import ann, bpe, html, licenses, line_dedup, near_dedup, packing, pii, quality, toxicity
from lodestone.llm.shared import lean, utf8

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    vocabulary = bpe.read_vocabulary()
    return bpe.Codec(bpe.model_proto(vocabulary), vocabulary)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_bpe_is_that_of_the_ranks(codec, texts):
    import public_tokenizers
    import tiktoken

    ranks = {x: i for i, x in enumerate(bpe.read_vocabulary())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offs = codec.encode(texts)
    back, cut = codec.decode(ids.astype(np.int64), offs)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == other.encode_ordinary(t)
        assert back[cut[i] : cut[i + 1]].tobytes().decode() == t


def test_quality_keys_by_hand():
    data, offs = utf8(pa.array(["abcdefg", "", "abcde", "abcdefabcdef"]))
    v, cut = quality.keys(data, offs)
    want = lambda s: [((int.from_bytes(s[i : i + 6].encode(), "big") * 11400714819323198485) % 2**64) >> 32 for i in range(len(s) - 5)]
    assert v.tolist() == want("abcdefg") + want("abcdefabcdef") and cut.tolist() == [0, 2, 2, 2, 9]


def test_quality_scores_are_the_same_without_a_broadcast(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    one, other = ({r.doc_id: r.score for r in quality.quality_scores(docs, labels, most=m).collect()} for m in (quality.BROADCAST_KEYS, 0))
    assert one == other and len(one) == docs.count() and min(one.values()) < quality.THRESHOLD < max(one.values())


def test_merging_counted_keys_holds_little_beside_them():
    rng = np.random.default_rng(1)
    parts = [(np.unique(rng.integers(0, 1 << 30, 300_000, dtype=np.uint64)), None) for _ in range(5)]
    parts = [(key, rng.integers(1, 9, len(key)).astype(np.int32)) for key, _ in parts]
    tracemalloc.start()
    key, n = quality._merged(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = np.concatenate([x for x, _ in parts])
    want, at = np.unique(every, return_inverse=True)
    assert (key == want).all() and (n == np.bincount(at, np.concatenate([x for _, x in parts])).astype(np.int64)).all()
    assert peak < 24 * len(every)  # 16 bytes a key are the result; all at once it was 52


def test_counts_of_a_task_are_whole_whatever_it_holds():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abé ", k=rng.randrange(60))) for _ in range(400)]
    good, langs = [rng.random() < 0.3 for _ in texts], [rng.choice(["en", "fr", ""]) for _ in texts]
    want = Counter()
    for t, g, lang in zip(texts, good, langs, strict=True):
        for k in quality.keys(*utf8(pa.array([t])))[0].tolist():
            want.update({(lang, k, "raw"): 1, (lang, k, "trusted"): int(g)})
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50]), pa.array(good[i : i + 50]), pa.array(langs[i : i + 50])], ["t", "g", "l"]) for i in range(0, 400, 50)]
    for held in (quality.HELD_KEYS, 3000, 1):
        got = Counter()
        for b in quality._counts(iter(batches), held):
            for r in b.to_pylist():
                got.update({(r["lang"], r["key"], c): r[c] for c in ("raw", "trusted")})
        assert got == want
    assert list(quality._counts(iter([]))) == []


def test_workers_give_back_what_they_freed():
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    kept = []

    def run(batches):
        for b in batches:
            many = [np.ones(11_000) for _ in range(2500)]  # 88 kB each, too small to be mapped for themselves
            kept.append(np.ones(5000))  # above them, so that they aren't the end of the heap
            yield resident()
            del many, b

    before = resident()
    most = list(lean(run)(iter([1])))
    assert most[0] > before + 150 and resident() < before + 60


def _jaccard(a, b):
    grams = lambda t: set(zip(t.lower().split(), t.lower().split()[1:]))
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    for t in texts[:15]:
        for cut in (0, 4, 10):
            own = t.split()
            for i in rng.sample(range(len(own)), cut):
                own[i] = rng.choice(words)
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in near_dedup.near_duplicates(df).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
    same = {(a, b) for g in got.values() for a, b in itertools.combinations(sorted(g), 2)}
    pairs = {p: _jaccard(texts[p[0]], texts[p[1]]) for p in itertools.combinations(range(len(texts)), 2)}
    sure = {p for p, j in pairs.items() if j >= 0.75}
    assert len(sure) > 40 and sure <= same
    assert all(pairs[p] > 0.3 for p in same)


def test_estimate_is_the_corrected_share():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**32, (1, 128), dtype=np.uint32)
    for share in (0.0, 0.5, 1.0):
        many = np.where(rng.random((200, 128)) < share, one, rng.integers(0, 2**32, (200, 128), dtype=np.uint32))
        assert abs(near_dedup.estimate(near_dedup.pack(one, 4), near_dedup.pack(many, 4), 4).mean() - share) < 0.02


def _best_fit(sizes, capacity):
    """Bins of best-fit decreasing, item by item."""
    room = []
    for s in sizes:
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(capacity - s)
    return len(room)


def test_patterns_and_plan():
    for classes, per in ((1, 1), (5, 3), (12, 4)):
        want = {c for k in range(1, per + 1) for c in itertools.combinations_with_replacement(range(classes, 0, -1), k) if sum(c) == classes}
        got = [tuple(int(x) for x in p if x) for p in packing.patterns(classes, per)]
        assert set(got) == want and len(got) == len(want)
    rng = np.random.default_rng(2)
    for _ in range(30):
        h = np.r_[0, rng.integers(0, 50, 16)]
        plan = packing.plan(h, 3)
        used = np.zeros(17, int)
        for seq, n in plan:
            assert n > 0 and sum(seq) <= 16
            for c in seq:
                used[c] += n
        assert (used == h).all()
        assert sum(n for _, n in plan) <= 1.03 * _best_fit(np.repeat(np.arange(17), h)[::-1].tolist(), 16) + 1
        seen = {}
        for c, lo, hi, _, _ in packing.slots(plan):
            seen.setdefault(c, []).append((lo, hi))
        for c, spans in seen.items():
            assert sorted(spans)[0][0] == 0 and sorted(spans)[-1][1] == h[c]


def test_nnls_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    pats = packing.patterns(12, 3)
    for _ in range(20):
        h = np.r_[0, rng.integers(0, 100, 12)]
        x = packing.nnls(pats, h)
        a = np.array([np.bincount(p, minlength=13)[1:] for p in pats]).T
        slope = a.T @ (h[1:] - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-5 and abs(slope[x > 0]).max(initial=0) < 1e-5


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(150):
        n, band = rng.randrange(1, 8), rng.randrange(1, 4)
        template = [rng.randrange(1, 5) for _ in range(n)]
        text = [rng.randrange(1, 5) for _ in range(n + 2 * band)]

        def best(i, j, template=template, text=text, band=band, n=n):
            if i == n or j == len(text):
                return 0
            out = max(best(i + 1, j), best(i, j + 1) if j + 1 <= i + 2 * band else 0)
            if template[i] == text[j] and i <= j <= i + 2 * band:
                out = max(out, 1 + best(i + 1, j + 1))
            return out

        matched, first, last = licenses.align(np.array(template, np.uint64), np.array([text], np.uint64), band)
        assert matched[0] == best(0, 0)
        if matched[0]:
            assert text[first[0]] in template and text[last[0]] in template and last[0] - first[0] + 1 >= matched[0]


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 1000, licenses.GRAM + licenses.WINDOW - 1).astype(np.uint64)
        a, b = (np.r_[rng.integers(1000, 2000, 9), shared, rng.integers(2000, 3000, 9)].astype(np.uint64) for _ in range(2))
        g = licenses.grams(a)
        assert set(g[licenses.winnow(g)]) & set(licenses.grams(b))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 1@.(at)[dot]－１２３​оне", max_size=60))
def test_spans_point_into_the_source(text):
    for _, lo, hi, value in pii.identifiers(text):
        assert 0 <= lo < hi <= len(text) and value


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("x jane (at) ex dot com y", "EMAIL", "jane (at) ex dot com"),
        ("ｊａｎｅ＠ｅｘ．ｃｏｍ", "EMAIL", "ｊａｎｅ＠ｅｘ．ｃｏｍ"),
        ("jаne@ex.cоm", "EMAIL", "jаne@ex.cоm"),
        ("call five five five, one two three four.", "PHONE", "five five five, one two three four"),
        ("no 4111 1111 1111 1111.", "CARD", "4111 1111 1111 1111"),
        ('token = "0123456789abcdef"', "SECRET", "0123456789abcdef"),
        ("+1 (017) 555-7713", "PHONE", "+1 (017) 555-7713"),
        ("at 10.0.0.1.", "IP", "10.0.0.1"),
    ],
)
def test_disguises(text, kind, source):
    (got,) = pii.identifiers(text)
    assert (got[0], text[got[1] : got[2]]) == (kind, source)


_DOTS = r"(?:[ \t]{0,2}[\[({<][ \t]{0,2}(?:dot|punto|point|punkt|\.)[ \t]{0,2}[\])}>][ \t]{0,2}|[ \t]{1,2}(?:dot|punto|point|punkt)[ \t]{1,2}|\.)"
_SLOW = re.compile(rf"(?<![A-Za-z0-9_+\-])[A-Za-z0-9][A-Za-z0-9_+\-]*(?:{_DOTS}[A-Za-z0-9][A-Za-z0-9_+\-]*)*(?:[ \t]{{0,2}}[\[({{<][ \t]{{0,2}}(?:at|arroba|@)[ \t]{{0,2}}[\])}}>][ \t]{{0,2}}|[ \t]{{0,2}}@[ \t]{{0,2}})[A-Za-z0-9][A-Za-z0-9_+\-]*(?:{_DOTS}[A-Za-z0-9][A-Za-z0-9_+\-]*)*{_DOTS}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["ann", "b7", "x-y", " dot ", "[.]", " (dot) ", ".", " (at) ", "[@]", " @ ", "@", " ", ", ", "com", "org"]), max_size=24))
def test_addresses_against_one_backtracking_pattern(parts):
    """The walk from each at against one pattern that tries everything: the same spans are rewritten."""
    text = "".join(parts)
    edits, at = [], 0
    while m := _SLOW.search(text, at):
        edits.append(m.span())
        at = m.end()
    got = pii._addresses(text)
    inside = lambda e: any(lo <= e[0] and e[1] <= hi for lo, hi in edits)
    assert all(inside(e) for e in got)
    out, at = [], 0
    for lo, hi, new in got:
        out += [text[at:lo], new]
        at = hi
    plain = "".join([*out, text[at:]])
    assert len(re.findall(r"(?<![A-Za-z0-9_+\-])[A-Za-z0-9][A-Za-z0-9_+.\-]*@[A-Za-z0-9][A-Za-z0-9_+\-]*(?:\.[A-Za-z0-9][A-Za-z0-9_+\-]*)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", plain)) >= len(edits)


def test_masks_long_disguises_whole():
    for text in ("a dot b dot c dot d dot e dot f dot g (at) x dot com", "ann (at) a dot b dot c dot d dot e dot f dot com", "n" * 80 + " (at) mail dot com", "a." * 3000 + "b (at) x.com"):
        assert pii.mask(f"to {text} now") == "to <EMAIL> now"


def _valid(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0 and len(set(number)) > 1


def test_cards_against_every_run_of_digits():
    """Every maximal run of 13 to 19 digits is a card exactly if the sum by hand says so."""
    rng = random.Random(11)
    for _ in range(400):
        runs = ["1" + "".join(rng.choice("0123456789") for _ in range(rng.randint(8, 21))) for _ in range(4)]
        text = " x ".join(runs)
        got = [v for k, _, _, v in pii.identifiers(text) if k == "CARD"]
        assert got == [r for r in runs if 13 <= len(r) <= 19 and _valid(r)]


@pytest.mark.parametrize("text", ["ISBN 9780306406157", "no 12345678901234567", "in 2001 2002 2003 2004", "version 1.2.3.4", "000-12-3456", "666-12-3456", "The token = standard unit", "1 2 3 4 5 6 7 8", "5551234567", "std::vector", "a::b", "id 0012345678901234", "un un un un un un un un un"])
def test_what_only_looks_like_an_identifier(text):
    assert pii.mask(f"so {text} is") == f"so {text} is"


@pytest.mark.parametrize(("text", "kind"), [("call 5551234567", "PHONE"), ("2001:db8::1", "IP"), ("fe80::1", "IP"), ("1:2:3:4:5:6:7:8", "IP"), ("123-45-6789", "SSN"), ("0033612345678", "PHONE")])
def test_bare_identifiers(text, kind):
    assert [x[0] for x in pii.identifiers(f"so {text} is")] == [kind]


@pytest.mark.parametrize("text", ["look at the dot product", "meet us at example.com", "one two three", "in 1999 and 2004", "a 1.5 b 2.25"])
def test_plain_prose_is_left_alone(text):
    assert pii.mask(text) == text


def test_neighbour_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.neighbour) for r in ann.neighbours(df, block=250, every=1).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(far, axis=1)[:, :10]) for j in row}
    assert len(got) == 6000 and len(got & true) >= 0.9 * len(true)
    some = {(r.vec_id, r.neighbour) for r in ann.neighbours(df, block=250).collect()}
    assert {i for i, _ in some} == set(range(0, 600, 50)) and len(some & true) >= 0.9 * 120


def test_neighbour_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        want |= {(int(ids[i]), int(j)) for j in ids[np.lexsort((ids, far))[:10]]}
    got = {(r.vec_id, r.neighbour) for r in ann.op7_ivf_pq(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_shared_tokens_against_windows():
    rng = random.Random(7)
    for trial in range(150):
        least, pages = rng.choice([1, 2, 3, 5, 6]), rng.choice([2, 3])
        own = [[rng.randrange(3 if trial % 2 else 8) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(6))]
        where = {}
        for i, p in enumerate(own):
            for j in range(len(p) - least + 1):
                where.setdefault(tuple(p[j : j + least]), set()).add(i)
        want = []
        for p in own:
            gone = [False] * len(p)
            for j in range(len(p) - least + 1):
                if len(where[tuple(p[j : j + least])]) >= pages:
                    gone[j : j + least] = [True] * least
            want += gone
        h, page = np.array([x for p in own for x in p], np.uint64), np.array([i for i, p in enumerate(own) for _ in p], np.int32)
        assert html.shared_tokens(h, page, least, pages).tolist() == want


def test_hosts_spread_over_executors_give_the_same(spark):
    rng = random.Random(13)
    phrases = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 30))) for _ in range(12)]
    rows = [(rng.choice([None, i % 40]), f"http://{rng.choice('ab')}.com/{i}", "<p>" + " ".join(rng.choice(phrases) if rng.random() < 0.5 else f"x{rng.randrange(10**6)}" for _ in range(9)) + "</p>") for i in range(60)]
    df = spark.createDataFrame([*rows, (1, None, phrases[0]), (2, "http://a.com", None)], "page_id long, url string, html string")
    for pages in (2, 3):
        one, other = (sorted(map(str, html.unique_text(df, least_pages=pages, big=big).collect())) for big in (html.BIG_HOST, 0))
        assert one == other and len(one) == 62
    parsed = df.filter("url IS NOT NULL").selectExpr("split(url, '/')[2] AS key", "page_id", "split(url, '/')[2] AS host", "coalesce(html, '') AS text")
    one, other = (sorted(map(str, html._spread(parsed, 12, 2, most=m).collect())) for m in (0, 10**6))
    assert one == other and len(one) == 61
    assert sum(r.n_removed for r in html.unique_text(df).collect()) > 100


def _shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_hosts_spread_over_executors_shuffle_few_bytes_a_token(spark):
    rng = random.Random(17)
    menu = " ".join(f"m{i}" for i in range(20))
    rows = [(i, f"http://a.com/{i}", "<p>" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(800)) + f"</p><p>{menu}</p>") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = _shuffled(spark)
    got = html.unique_text(df, big=0).collect()
    assert len(got) == 200 and {(r.n_tokens, r.n_removed) for r in got} == {(820, 20)}
    assert _shuffled(spark) - before < 4 * 200 * 820  # 16 bytes and more for each token, when each sent a rank


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for numbers in (np.zeros(0, np.int64), np.array([0, 127, 128, 16383, 16384, 1 << 40]), rng.integers(0, 1 << rng.integers(1, 40, 500))):
        data, size = html._pack(numbers)
        assert html._unpack(data.tobytes()).tolist() == numbers.tolist() and size.sum() == len(data)


def _templates(lines, depth, similarity):
    """One template after another, each line against all of its leaf."""
    out, made = [], []
    for line in lines:
        best, most = None, -1
        for k, t in enumerate(made):
            same = sum(a == b for a, b in zip(t, line, strict=True))
            if same > most:
                best, most = k, same
        if best is not None and most >= similarity * len(line) - 1e-9:
            made[best] = [a if a == b else None for a, b in zip(made[best], line, strict=True)]
        else:
            best = len(made)
            made.append(list(line))
        out.append(best)
    return out


def test_clusters_of_a_leaf():
    rng = np.random.default_rng(8)
    for n in (1, 5, 30, 60):
        lines = rng.integers(0, 4, (n, 10))
        lines[:, :3] = 0
        got = line_dedup.cluster(lines, 0.8, 3)
        want = _templates(lines.tolist(), 3, 0.8)
        pairs = lambda c: {(i, j) for i in range(n) for j in range(i) if c[i] == c[j]}
        assert pairs(got) == pairs(want)


def test_recurring_lines_go(spark):
    notice = "Posted on day {} by the site team"
    data = [(i, f"{' '.join('abcdefgh'[(i + j * j) % 8] * (j + 2 + i) for j in range(6))}\n{notice.format(i)}\nend {'stuvwxyz'[i]} here") for i in range(8)]
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert "Posted" in out[0] and not any("Posted" in out[i] for i in range(1, 8))
    assert all(out[i].split("\n")[0] == data[i][1].split("\n")[0] for i in range(8))


def test_recurring_against_one_document_after_another(spark):
    """Templates, document counts and first documents by a plain loop over all lines, with leaves split beforehand or not."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.randrange(4)
            if kind == 0:
                lines.append("a b c k l m n " + " ".join(rng.choice("xyz") for _ in range(3)))
            elif kind == 1:
                lines.append(f"row {rng.randrange(9)} {rng.randrange(9)} of table")
            elif kind == 2:
                lines.append(rng.choice(["short line", "one", "two words here", ""]))
            else:
                lines.append(" ".join(rng.choice("pqrstuv") for _ in range(5)))
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen: dict = {}
    for doc, text in enumerate(texts):
        for line in text.split("\n"):
            words = tuple(0 if any(c.isdigit() for c in w) else w for w in line.split())
            if words:
                seen.setdefault((len(words), words[:3]), {}).setdefault(words, set()).add(doc)
    for big in (line_dedup.BIG_LEAF, 1):
        lines, found = line_dedup.recurring(df, big=big)
        got = {(r.line, r.template): (r.docs, r.first) for r in found.collect()}
        where = {}
        for r in lines.collect():
            words = tuple(0 if any(c.isdigit() for c in w) else w for w in texts[r.doc].split("\n")[r.number].split())
            where[words] = r.line
        want = {}
        for kinds in seen.values():
            order = sorted(kinds, key=lambda w: where[w])
            no = _templates([list(w) for w in order], 3, 0.8) if len(order[0]) > 3 else list(range(len(order)))
            for k in set(no):
                own = [w for w, n in zip(order, no, strict=True) if n == k]
                docs = set().union(*(kinds[w] for w in own))
                if len(docs) >= line_dedup.MIN_DOCS:
                    want |= {where[w]: (len(docs), min(docs)) for w in own}
        assert {line: v for (line, _), v in got.items()} == want and len(want) > 9
        assert any(line != template for line, template in got)


def test_copies_count_as_one_document(spark):
    page = "Some words that only this text has\nand another line of it"
    df = spark.createDataFrame([(i, page) for i in range(8)] + [(20 + i, f"{'abcdefgh'[i]} {'stuvwxyz'[i]} words\nshared by all of them") for i in range(8)], "doc_id long, text string")
    groups = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, group_id long")
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df, copies=groups).collect()}
    assert all(out[i] == page for i in range(8)) and "shared" in out[20] and "shared" not in out[21]
    left = line_dedup.drop_recurring_lines(df, keep_emptied=False).collect()
    assert sorted(r.doc_id for r in left) == [0, *range(20, 28)]


def test_ordinal_fit_finds_the_weights():
    rng = np.random.default_rng(9)
    x = (rng.random((20_000, 5)) < 0.3).astype(float)
    w, b = np.array([2.0, -1.0, 0.5, 0.0, 1.0]), np.array([0.5, 2.0])
    u, z = rng.random(len(x)), x @ w
    y = sum((u < 1 / (1 + np.exp(t - z))).astype(int) for t in b)
    got_w, got_b = toxicity.fit_ordinal(x, y, 3, 1e-6)
    assert np.abs(got_w - w).max() < 0.15 and np.abs(got_b - b).max() < 0.15


def test_ordinal_loss_is_least_and_scores_are_plain_sums(spark):
    rng = np.random.default_rng(10)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    y = rng.integers(0, 3, 300)
    w, b = toxicity.fit_ordinal(x, y, 3, 0.01)

    def loss(w, b):
        total = 0.0
        for row, grade in zip(x.tolist(), y.tolist(), strict=True):
            z = sum(a * c for a, c in zip(row, w, strict=True))
            above = [1.0, *(1 / (1 + np.exp(t - z)) for t in b), 0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total / len(y) + 0.005 * sum(c * c for c in w)

    best = loss(w, b)
    for _ in range(60):
        dw, db = rng.normal(0, 0.05, 4), rng.normal(0, 0.05, 2)
        if b[0] + db[0] < b[1] + db[1]:
            assert loss(w + dw, b + db) >= best - 1e-9

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weight, thresholds = toxicity.fit(docs, labels)
    assert (weight != 0).any()
    known: dict[bytes, list[int]] = {}

    def numbers(word):  # of the buckets of a word and of its beginnings
        if word not in known:
            data = np.frombuffer(word, np.uint8)
            known[word] = [int(f) for f in toxicity.features(data, np.array([0, len(data)]))[1] if f < 1 << toxicity.HASH_BITS]
        return known[word]

    got = {r.doc_id: r.severity for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.select("doc_id", "text").limit(60).collect():
        times: dict[int, int] = {}
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", r.text.encode()):
            for f in numbers(word.lower() if word.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in word)):
                times[f] = times.get(f, 0) + 1
        z = sum(float(weight[f + (level << toxicity.HASH_BITS)]) for f, n in times.items() for level, least in enumerate(toxicity.LEVELS) if n >= least)
        assert got[r.doc_id] == pytest.approx(sum(1 / (1 + np.exp(t - z)) for t in thresholds), abs=1e-4)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("pmod(hash(doc_id), 3) > 0"), labels.filter("pmod(hash(doc_id), 3) = 0")
    got = toxicity.score_toxicity(docs, train).drop("toxic").join(test, "doc_id").collect()
    hit = sum(r.severity >= toxicity.THRESHOLD for r in got if r.toxic)
    wrong = sum(r.severity >= toxicity.THRESHOLD for r in got if not r.toxic)
    assert hit >= 0.85 * sum(r.toxic for r in got) and wrong <= 0.01 * len(got)


def test_whole_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    got = corpus_pipeline.run(spark, ROOT).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.5 * docs.count()
    assert not any(pii.identifiers(r.text) for r in got)
    assert all(len(r.text.split()) == r.n_words or r.n_words == packing.CAPACITY for r in got)
