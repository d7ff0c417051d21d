import random

from invented import prose
from hypothesis import given
from hypothesis import strategies as st

from caseloom.llm import decontaminate


def distances(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[1:]


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=60))
def test_bit_parallel_distance(pattern, text):
    assert decontaminate.myers(pattern, text) == distances(pattern, text)


def edited(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, "q"), lambda: out.__setitem__(at, "q")])()
    return "".join(out)


def cases():
    items = [(i, prose(1000 + i, 12 + i)) for i in range(12)] + [(12, None), (13, " . "), (14, "short one"), (3, prose(1003, 15))]
    docs = []
    for i in range(60):
        middle = items[i % 12][1]
        edits = i // 12 * 3
        docs.append((i, f"{prose(i, 30)} {edited(middle, edits, i)}, {prose(500 + i, 25)}"))
    docs += [(60, prose(77, 200)), (61, None), (62, ""), (63, "a Short, one."), (None, docs[0][1]), (0, docs[0][1])]
    return docs, items


def brute(docs, items):
    for doc_id, text in docs:
        plain = decontaminate.normalised(text or "")
        for item_id, item in {(i, decontaminate.normalised(t or "")) for i, t in items}:
            if len(item) >= decontaminate.LEAST_CHARS and plain:
                least = min(distances(f" {item} ", f" {plain} "))
                if least <= decontaminate.budget(len(item)):
                    yield doc_id, item_id, least


def test_matches_equal_brute_force(spark, make):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "0 AS doc_id")
    wanted = sorted(brute(docs, items), key=str)
    for block in (1 << 20, 200):
        found = decontaminate.matches(make(docs, extra=True), table, block_chars=block)
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in found.collect()), key=str) == wanted
    hit = {d for d, _, _ in wanted}
    kept = decontaminate.clean(make(docs, extra=True), table, block_chars=200)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)
    assert kept.columns == make(docs, extra=True).columns


def test_empty_tables(spark, make):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(make([(1, "x")]), items).count() == 0
    assert decontaminate.clean(make([(1, "x")]), items).count() == 1
    some = spark.createDataFrame([(1, prose(1, 20))], "item_id bigint, text string")
    assert decontaminate.matches(make([]), some).count() == 0


def test_short_items_and_parts_of_words(spark, make):
    items = spark.createDataFrame([(1, "A."), (2, "cat sat on a mat, he did"), (3, "is")], "item_id bigint, text string")
    docs = make([(1, "a clean cat sat"), (2, "the cat sat on a mat: he did it"), (3, "bobcat sat on a mat he didnt"), (4, "this is")])
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()] == [(2, 2)]
    found = decontaminate.matches(docs, items, least_chars=1).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 3)]
    assert decontaminate.clean(docs, items).count() == 3


def test_places_and_long_texts(spark, make):
    item = prose(5, 20)
    text = f"{prose(6, 50_000)} {item} {prose(7, 50_000)}"
    row = decontaminate.matches(make([(1, text), (2, item)]), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    for r in row.collect():
        plain = decontaminate.normalised(text if r.doc_id == 1 else item)
        assert r.distance == 0 and plain[r.begin : r.end] == decontaminate.normalised(item)


def test_many_blocks(spark, make):
    items = [(i, prose(2000 + i, 10)) for i in range(30)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    blocks, n = decontaminate._blocks(table, 400, 20)
    assert n > 3 and blocks.where("block < 0 OR block >= " + str(n)).count() == 0 and blocks.count() == 30
    docs = make([(i, f"so {t} it is") for i, t in items])
    found = decontaminate.matches(docs, table, block_chars=400).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.distance == 0} >= {(i, i) for i, _ in items}
