import random
import re

import numpy as np
import pytest
from invented import prose
from hypothesis import given
from hypothesis import strategies as st

from caseloom.llm import jaccard
from caseloom.llm.components import components


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(seed, copies, length, changes):
    base = prose(seed, length).split()
    for i in range(copies):
        rng, words = random.Random(seed * 1000 + i), list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def rows():
    texts = [*family(1, 40, 120, 4), *family(2, 30, 300, 9), *family(3, 20, 60, 3)]
    passage = prose(50, 60)
    texts += [f"{prose(i, 80)} {passage}" for i in range(60, 100)]
    texts += [prose(i, 100) for i in range(200, 230)]
    texts += ["a b c", "A  b\nC", "a b", "", None, "x y z w v", "X y z w v"]
    rng = random.Random(5)
    rng.shuffle(texts)
    return [(i + 1, t) for i, t in enumerate(texts)]


def result(found):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)


@pytest.mark.parametrize("small_tile, common", [(64, 64), (4, 64), (4, 8), (8, 1000)])
def test_equals_brute_force(make, rows, monkeypatch, small_tile, common):
    """Also with large tiles, where only neighbours are compared at first."""
    monkeypatch.setattr(jaccard, "SMALL_TILE", small_tile)
    monkeypatch.setattr(jaccard, "COMMON", common)
    assert result(jaccard.near_duplicates(make(rows))) == sorted(brute(rows), key=str)


def brute_links(rows):
    """Sets that are similar enough to that of each row, other than its own."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    different = set(sets) - {frozenset()}
    similar = lambda x, y: x != y and 100 * len(x & y) >= 80 * len(x | y)
    count = {x: sum(similar(x, y) for y in different) for x in different}
    return {d: count.get(s, 0) for (d, _), s in zip(rows, sets)}


@pytest.mark.parametrize("sets, tokens", [(1024, 2048), (16, 50)])
def test_all_links_are_counted(make, rows, monkeypatch, sets, tokens):
    """Also in a group of more near copies than a small tile has."""
    monkeypatch.setattr(jaccard, "COUNT_SETS", sets)
    monkeypatch.setattr(jaccard, "COUNT_TOKENS", tokens)
    rows = [*rows, *((1000 + i, t) for i, t in enumerate(family(9, 150, 200, 6)))]
    wanted = brute_links(rows)
    assert max(wanted.values()) > jaccard.SMALL_TILE
    assert {r.doc_id: r.n_links for r in jaccard.near_duplicates(make(rows)).collect()} == wanted


def test_without_broadcasts(make, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_TOKENS", 0)
    assert result(jaccard.near_duplicates(make(rows))) == sorted(brute(rows), key=str)


def test_edges(make, edge_rows):
    assert result(jaccard.near_duplicates(make(edge_rows, extra=True))) == sorted(brute(edge_rows), key=str)
    assert jaccard.near_duplicates(make([])).count() == 0


@given(st.sets(st.integers(0, 400), max_size=60), st.sets(st.integers(0, 400), max_size=60))
def test_bitmaps_bound_the_overlap(x, y):
    mix = lambda s: np.array(sorted(hash((v, 1)) & (2**63 - 1) for v in s), np.uint64)
    for p in (64, 256):
        for q in (64, 128):
            bound = jaccard.overlap_bound(jaccard.bitmap(mix(x), p), len(x), jaccard.bitmap(mix(y), q), len(y))
            assert bound >= len(x & y)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 7), (1299, 1300)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {found[i] for i in range(201)} == {0}
    assert {found[i] for i in range(1000, 1301)} == {1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_marked_tokens_come_last():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 9, 12)
        values = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in sizes]).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        of, late = np.repeat(np.arange(12), sizes), rng.random(len(values)) < 0.4
        found = jaccard._late_last(jaccard.Sets(values, bounds, np.zeros(12, np.uint64)), of, late)
        assert found.tolist() == values[np.lexsort((values, late, of))].tolist()
