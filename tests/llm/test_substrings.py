import hashlib
import re

import numpy as np
import pytest
import xxhash
from invented import prose

from caseloom.llm import arrow, substrings


def brute(rows, size=20):
    """Rows that are equal are one document; others with one id in an unspecified order."""
    order = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for row in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[row] = len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept
    return [(r[0], *out[r]) for r in rows]


def rows():
    shared, other = prose(900, 45), prose(901, 20)
    out = [(i, f"{prose(i, 15 + i)} {shared} {prose(300 + i, 10)}") for i in range(20)]
    out += [(20, f"{other} x {other}\n{other}"), (21, other), (22, " ".join([*other.split()[:19], "y"]))]
    out += [(30, "a " * 60), (31, "a " * 19), (32, prose(5, 4000)), (33, prose(5, 4000)), (34, None), (35, ""), (None, shared)]
    return out


def compared(found):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found.collect()), key=str)


@pytest.mark.parametrize("group_bytes", [4 << 20, 2000])
def test_equals_brute_force(make, monkeypatch, group_bytes):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", group_bytes)
    data = rows()
    assert compared(substrings.remove_repeats(make(data))) == sorted(brute(data), key=str)


def test_edges(make, edge_rows):
    found = substrings.remove_repeats(make(edge_rows, extra=True))
    assert found.count() == len(edge_rows)
    assert {r.row.tie for r in found.collect()} == {3}
    by_id = {(r.doc_id, r.text): r for r in found.collect()}
    assert by_id[(9, prose(1, 60))].n_removed == 60  # a copy of document 1
    assert by_id[(1, prose(1, 60))].n_removed == 0  # equal rows are one document
    assert by_id[(4, " \n\t ")].n_words == 0 and by_id[(2, None)].kept == ""
    assert substrings.remove_repeats(make([])).count() == 0


def test_unique_windows_whose_symbols_agree(make):
    """Pairs of texts that differ in their first word, where the upper 32 bits of its quarter's hash agree."""
    fixed = [np.uint64(xxhash.xxh3_64_intdigest(w.encode(), 0)) for w in prose(77, 20).split()]
    ids = np.array([xxhash.xxh3_64_intdigest(b"id%d" % i, 0) for i in range(300_000)], np.uint64)
    total = np.zeros(len(ids), np.uint64)
    for j in range(5):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + (fixed[j] if j else ids)
    symbol = arrow.mixed(total) >> np.uint64(32)
    order = np.argsort(symbol)
    again = np.flatnonzero(symbol[order][1:] == symbol[order][:-1])
    assert len(again)
    words = prose(77, 20).split()
    data = [(i, " ".join([f"id{k}", *words[1:]])) for i, k in enumerate(order[[*again, *(again + 1)]])]
    assert compared(substrings.remove_repeats(make(data))) == sorted(brute(data), key=str)


def test_ranges_cover_what_is_removed(make):
    text = prose(11, 30)
    found = {r.doc_id: r for r in substrings.remove_repeats(make([(1, text), (2, f"q {text} r")])).collect()}
    assert found[2].ranges == [[1, 31]] and found[2].kept == "q r" and found[1].ranges == []


def test_prefix_groups_are_small_and_complete():
    rng = np.random.default_rng(1)
    high = rng.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(1)
    high[:1000] = high[0]
    low = rng.integers(0, 2**63, 5000).astype(np.uint64)
    groups = list(substrings.subtree_groups(high, low, 100))
    assert sorted(np.concatenate(groups).tolist()) == list(range(5000))
    assert max(map(len, groups)) <= 100
    assert len(groups) < 1000
