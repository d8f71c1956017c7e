"""The Jaccard join against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from sparkring.llm import jaccard, tables


def shingles(text: str | None, size: int) -> set:
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """Rows that share a doc_id are one document; those without one link with nothing."""
    sets = [shingles(t, size) for _, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        x, y = rows[i][0], rows[j][0]
        if a and b and x is not None and y is not None and 100 * len(a & b) >= percent * len(a | b):
            u, v = sorted((find(x), find(y)))
            parent[v] = u
    return sorted((repr(k), len(s), repr(None if k is None else find(k) if s else k)) for (k, _), s in zip(rows, sets, strict=True))


def actual(spark, rows: list[tuple], size: int, percent: int) -> list[tuple]:
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n int, component string").repartition(3)
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in jaccard.join(docs, size, percent).collect())


def near_copies(rng: random.Random, base: list[str], n: int, edits: int) -> list[str]:
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts: list[str | None] = [None, "", "   ", "one", "ONE", "one two", "one two three", "long " * 500]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(4, 120))]
        texts += near_copies(rng, base, rng.randrange(1, 6), 3)
    texts += [t.upper() for t in texts[-4:]] + texts[10:14]
    return [(i * 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80)])
def test_join(spark, seed, size, percent):
    rows = corpus(seed) + [(None, "one two three"), (None, None)]
    assert actual(spark, rows, size, percent) == expected(rows, size, percent)


def test_rows_of_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")]
    assert actual(spark, rows, 4, 85) == expected(rows, 4, 85)


def test_common_shingles(spark, monkeypatch):
    """Long lists: near copies of one text and a line that most documents share, with small bounds to reach all paths."""
    for name, value in (("SHORT_LIST", 6), ("BLOCK", 16), ("COMMON", 40)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    line = "all rights reserved by the people who wrote this down"
    texts = near_copies(rng, base, 150, 5) + [f"{line} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randrange(12)))}" for _ in range(60)]
    rows = list(enumerate(texts))
    assert actual(spark, rows, 4, 85) == expected(rows, 4, 85)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert actual(spark, [(7, None)], 4, 85) == [("7", 0, "7")]


def test_prefixes_never_lose_a_link():
    """Pairs that link share as many prefix shingles as either asks for."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 80))
        a = rng.choice(1000, n, replace=False)
        b = a.copy()
        b[: int(n * 0.08)] = rng.choice(np.arange(1000, 2000), int(n * 0.08), replace=False)
        if 100 * len(set(a) & set(b)) < 85 * len(set(a) | set(b)):
            continue
        for la, lb in itertools.product(range(1, 5), repeat=2):
            la, lb = min(la, -(-n * 85 // 100)), min(lb, -(-n * 85 // 100))
            pa_, pb = sorted(a)[: n - -(-n * 85 // 100) + la], sorted(b)[: n - -(-n * 85 // 100) + lb]
            assert len(set(pa_) & set(pb)) >= min(la, lb)


def test_choice_of_matches():
    assert jaccard.choose(np.ones(100, dtype=np.int64), 1, 85) == 1
    cheap, dear = np.ones(100, dtype=np.int64), np.array([500] * 16 + [1] * 84)
    assert jaccard.choose(dear, 100, 85) > 1 >= jaccard.choose(np.array([1] * 16 + [10**6] * 84), 100, 85)
    assert 1 <= jaccard.choose(cheap, 100, 85) <= jaccard.MOST_MATCHES


def test_verification_and_blocks():
    a, b = np.arange(100, dtype=np.uint64), np.arange(8, 100, dtype=np.uint64)
    assert jaccard.linked(a, b, 92) and not jaccard.linked(a, b, 93) and not jaccard.linked(a, a[:0], 1)
    rows = pd.DataFrame({"doc": [1, 2, 3], "comp": [1, 2, 3], "n": [20, 20, 20], "matches": [1, 1, 1], "tokens": [[5, 6], [5, 7], [6, 8]], "hots": [[5, 6], [5], [6]]})
    assert jaccard.compare(5, rows[:2], rows[:2], True, 85) == [(1, 2)]
    # The first common long list is that of 5 for 1 and 2, of 6 for 1 and 3.
    assert jaccard.compare(6, rows[::2], rows[::2], True, 85) == [(1, 3)]


def test_components(spark):
    from sparkring.plans.components import contract as components

    links = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 30), (None, 4), (5, None), *((100, k) for k in range(101, 160)), *((k, k + 1) for k in range(200, 240))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), tables.Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{k: 100 for k in range(100, 160)}, **{k: 200 for k in range(200, 241)}}
