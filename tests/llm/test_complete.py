"""Nothing that the corpus operators are to find is cut off by a gate or a missing case."""

import numpy as np
import pytest

from lodestone.llm import ann, licenses, pii


@pytest.mark.parametrize("text", ["jane@example[.]com", "jane[@]example.com", "jane (@) example.com", "jane @ example.com"])
def test_disguised_address(text):
    assert pii.identifiers(f"Ask {text}, or call.") == [("EMAIL", 4, 4 + len(text), "jane@example.com")]
    assert pii.mask(f"Ask: {text}") == "Ask: <EMAIL>"


def test_disguised_address_in_words():
    assert pii.mask("Voir: jean at exemple point fr, merci") == "Voir: <EMAIL>, merci"
    for text in ("look at example.com", "see you at ten. The point is clear", "a [.] b"):
        assert pii.mask(text) == text


def test_every_template_is_found_as_itself(spark):
    names = list(licenses.TEMPLATES)
    docs = spark.createDataFrame([(i, f"Some words before. {licenses.TEMPLATES[n]} Some words after.") for i, n in enumerate(names)], "doc_id long, text string")
    got = {(names[r.doc_id], r.license) for r in licenses.scan_licenses(docs).collect() if r.coverage == 1.0}
    assert {(n, n) for n in names} <= got
    assert {"Proprietary-short", "AGPL-3.0"} <= set(names)


def test_all_rights_reserved(spark):
    docs = spark.createDataFrame([(1, "A text.\nAll rights reserved.\nIts end."), (2, "All rights are reserved for later."), (3, licenses.TEMPLATES["Proprietary"])], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.start) for r in licenses.scan_licenses(docs).collect()) == [(1, "Proprietary-short", 8), (3, "Proprietary", 0)]


@pytest.mark.parametrize("spread", [0.0, 1e-3])
def test_neighbours_in_a_tight_cluster(spread):
    """More equal or almost equal vectors than are reranked first: none of the nearest is lost, equals are in the order of ids."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (900, 16)).astype(np.float32)
    v[:700] = v[0] + rng.normal(0, 1, (700, 16)) * spread
    v_id = rng.permutation(900).astype(np.int64)
    coarse = v[[0, 710, 720, 730]].copy()
    home = ann.nearest(v, coarse)
    books = rng.normal(0, 0.7, (4, 16, 4)).astype(np.float32)
    q_at = np.r_[:40, 800:820]
    code = np.stack([ann.nearest((v - coarse[home]).reshape(900, 4, 4)[:, p], books[p]) for p in range(4)])
    got = ann.search_block(v[q_at], v_id[q_at], np.ones((len(q_at), 4), bool), v, v_id, home, code, coarse, books, 10, 64)
    found = {}
    for q, n, far in zip(*got, strict=True):
        found.setdefault(q, []).append((far, n))
    for at in q_at:
        true = sorted((x, i) for x, i in zip(((v[at] - v).astype(np.float64) ** 2).sum(axis=1), v_id, strict=True) if i != v_id[at])[:10]
        assert [i for _, i in found[v_id[at]]] == [i for _, i in true]
