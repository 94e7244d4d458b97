"""Near-duplicates against brute force over all pairs of sets."""

import random

import pytest

from hornfels.llm import near_dedup
from hornfels.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept string"


def sets(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_force(rows, size):
    """Component of each id: texts of one id are one document."""
    rows = [r for r in rows if r[0] is not None]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, sets(t, size)) for i, t in rows]
    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def check(spark, rows, size=4):
    df = spark.createDataFrame([(i, t, "other") for i, t in rows], SCHEMA)
    out = near_dedup.near_duplicates(df, size).collect()
    expected = brute_force(rows, size)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    return out


def test_groups_edges_and_odd_rows(spark):
    texts = near_copies(40, 120, 14, 1) + near_copies(3, 30, 3, 2) + ["same text here"] * 4 + ["Same TEXT  here\n", "one", "one", "", None, "   ", "a b c d"]
    rng = random.Random(3)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(None, "same text here"), (None, None)]
    rows.append(rows[0])  # a repeated row
    out = check(spark, rows)
    assert {r.n_shingles for r in out if r.doc_id == ids[-1]} == {1}


def test_texts_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"), (9, ""), (7, "q"), (7, None), (8, "r"), (8, "q")]
    out = check(spark, rows)
    assert {r.component_id for r in out if r.doc_id in (1, 5, 9)} == {1} and {r.component_id for r in out if r.doc_id in (7, 8)} == {7}
    rng = random.Random(11)
    texts = near_copies(25, 60, 6, 12) + near_copies(25, 40, 4, 13) + [f"alone {k} text here" for k in range(30)]
    check(spark, [(rng.randrange(60), t) for t in texts])


def test_a_very_long_text_is_compared_whole(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = words[:59_000] + [f"x{k}" for k in range(1000)]
    half = words[:30_000]
    check(spark, [(3, " ".join(words)), (2, " ".join(other)), (1, " ".join(half))])


@pytest.mark.parametrize("part", [7, 2000])
def test_hot_group_in_parts(spark, monkeypatch, part):
    """A chain-like group whose pairs lie around the threshold, with buckets cut into small parts."""
    monkeypatch.setattr(near_dedup, "PART", part)
    texts = near_copies(120, 80, 9, 5) + near_copies(20, 80, 5, 6)
    check(spark, list(enumerate(texts)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).collect() == []
    assert near_dedup.drop_near_duplicates(df).columns == ["doc_id", "text"]


def test_one_document_of_each_group_stays(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (9, "h i j k l m", "z"), (None, "a b c d e f g", "n")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.lang) for r in near_dedup.drop_near_duplicates(df).collect()) == [(0, "n"), (3, "y"), (9, "z")]


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both, only = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, (2, 50)).astype(np.uint64)
        odd = [np.frombuffer(near_dedup.odd_sketch(near_dedup.min_hashes(np.unique(np.concatenate([both, o])))), np.uint64) for o in only]
        errors.append(int(np.bitwise_count(odd[0] ^ odd[1]).sum()) - near_dedup._largest_count())
    assert max(errors) < 0  # similarity 0.8: none beyond the limit for candidates


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 5), (100, 100)]
    out = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {k: (k // 10) * 10 for k in range(0, 40)} | {100: 0}
