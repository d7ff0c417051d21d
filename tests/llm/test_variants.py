import random
from collections import defaultdict

import pytest

from caseloom.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]


def brute(counts, ratio=10):
    cut = defaultdict(set)
    for w in counts:
        cut[w].add(w)
        for i in range(len(w) if len(w) < 100 else 0):
            cut[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    long = [w for w in counts if len(w) >= 99]
    for a in long:
        near[a] |= {b for b in long if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=str)


@pytest.fixture
def words(spark):
    return lambda counts: spark.createDataFrame(list(counts.items()), "word string, n bigint")


def found(df, **options):
    return sorted(map(tuple, variants.group_variants(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed, alphabet, longest", [(1, "ab", 9), (2, "abc", 6), (3, "aé日𝄞", 12), (4, "abcdefgh", 20)])
def test_random_words(words, seed, alphabet, longest):
    rng = random.Random(seed)
    counts = {}
    for _ in range(150):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        for _ in range(rng.randint(1, 4)):
            counts[word] = rng.choice([1, 2, 10, 20, 100, 300, 1000])
            at = rng.randint(0, len(word))
            word = word[:at] + rng.choice(alphabet) * rng.randint(0, 1) + word[at + rng.randint(0, 1) :]
    assert found(words(counts)) == brute(counts)


def test_forks_behind_the_edit(words):
    """Words that part again and again after the place of the edit."""
    stem = "middleofword"
    counts = {}
    for first in "xyz":
        for i in range(1, 40):
            counts[stem + first + "ab" * i] = i
            counts[stem + first + "ab" * i + "q"] = 50 * i
    assert found(words(counts)) == brute(counts)


def test_edges(spark, words):
    long = "".join(random.Random(9).choice("abc") for _ in range(20_000))
    counts = {"": 3, "a": 40, "b": 40, "ab": 1, "A": 7, long: 5, long[:9_000] + "x" + long[9_001:]: 60, long + "y": 1, long[1:]: 700, "a" * 300: 2, "a" * 301: 30}
    assert found(words(counts)) == brute(counts)
    rows = [*counts.items(), ("a", 2), (None, 5), ("zz", None)]
    table = spark.createDataFrame(rows, "word string, n bigint").selectExpr("*", "1 AS id", "2 AS node", "3 AS root", "4 AS `a.b`")
    assert found(table) == brute(counts | {"a": 42})
    assert found(words({"x": 1}).where("n > 1")) == []
    assert found(words({"x": 1})) == [("x", None, "x", 1, 0, None)]
    with pytest.raises(ValueError):
        variants.group_variants(words({"x": 1}), ratio=1)


def test_chains_of_forms(words):
    chain = {"a" * 8 + "b" * i: 10**i for i in range(9)}
    assert found(words(chain)) == brute(chain)
    assert {r[2] for r in brute(chain)} == {"a" * 8 + "b" * 8}


def test_many_words_with_one_beginning(words):
    counts = {f"samebeginning{i:04}": 1 + i % 7 * 30 for i in range(1500)}
    assert found(words(counts)) == brute(counts)
