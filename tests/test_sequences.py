"""Words, vocabularies, fixed-length ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.operators import sequences as S

TEXTS = {
    1: "the cat sat on the mat", 2: "  the\n dog ", 3: "", 4: None, 5: "zebra " * 9, 6: "the the the cat unknown1",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, text string")


@pytest.fixture(scope="module")
def vocab(texts):
    return S.vocabulary(texts, "text")


def test_vocabulary_order(vocab):
    counts = Counter(w for t in TEXTS.values() if t for w in t.split())
    ordered = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    found = [(r.token, r.n, r.token_id) for r in vocab.orderBy("token_id").collect()]
    assert found == [(w, n, i + S.FIRST_ID) for i, (w, n) in enumerate(ordered)]


def test_limited_vocabulary(texts):
    small = S.vocabulary(texts, "text", max_size=2)
    assert {r.token for r in small.collect()} == {"zebra", "the"}


@pytest.mark.parametrize("head", [0, 1, 2, 100])
def test_encode_decode_round_trip(texts, vocab, head):
    encoded = S.encode(S.token_rows(texts, ["id"], {"text": "text"}), vocab, head)
    arrays = S.id_arrays(encoded, ["id"], ["text"])
    decoded = S.decode(arrays.withColumnRenamed("text", "ids"), vocab, ["id"], "ids", head=head)
    assert {r.id: r.text for r in decoded.collect()} == {i: " ".join((t or "").split()) for i, t in TEXTS.items()}


@pytest.mark.parametrize("head", [0, 100])
def test_words_outside_the_vocabulary(texts, head):
    small = S.vocabulary(texts, "text", max_size=2)
    encoded = S.encode(S.token_rows(texts, ["id"], {"text": "text"}), small, head)
    ids = {r.id: r.text for r in S.id_arrays(encoded, ["id"], ["text"]).collect()}
    assert ids[2] == [4, S.UNKNOWN_ID] and ids[3] == ids[4] == []


@pytest.mark.parametrize("end_id", [None, S.END_ID])
@pytest.mark.parametrize("n", [0, 3, 4, 5, 9])
def test_fixed_length(spark, n, end_id):
    ids, mask = S.fixed_length(F.array(*[F.lit(i + 10) for i in range(n)]).cast("array<int>"), 5, end_id=end_id)
    row = spark.range(1).select(ids.alias("i"), mask.alias("m")).first()
    kept = [i + 10 for i in range(n)][: 5 if end_id is None else 4] + ([] if end_id is None else [end_id])
    assert row.i == kept + [0] * (5 - len(kept))
    assert row.m == [1] * len(kept) + [0] * (5 - len(kept))


def test_examples(spark, texts, vocab):
    cases = texts.select("id", "text", F.reverse(F.coalesce("text", F.lit("the"))).alias("target"), F.lit(1).alias("cancer_risk"))
    cases = cases.withColumn("target", F.when(F.col("id") == 1, "the cat").otherwise(F.lit("")))
    made = {r.id: r for r in S.examples(cases, vocab, ["id"], "text", "target", max_len=6).collect()}
    assert len(made) == len(TEXTS)
    ids = {r.token: r.token_id for r in vocab.collect()}
    first = made[1]
    assert first.input_ids == [ids[w] for w in "the cat sat on the".split()] + [1]
    assert first.attention_mask == [1] * 6 and first.labels == [ids["the"], ids["cat"], 1, 0, 0, 0]
    assert first.class_labels == 1
    assert made[4].input_ids == [1, 0, 0, 0, 0, 0] and made[4].attention_mask == [1, 0, 0, 0, 0, 0]


def test_special_ids_are_skipped(spark, vocab):
    df = spark.createDataFrame([(1, [3, 0, 2, 1, 4]), (2, [0, 0])], "id int, ids array<int>")
    assert {r.id: r.text for r in S.decode(df, vocab, ["id"], "ids").collect()} == {1: "zebra the", 2: ""}


def _moved(df):
    """Bytes that the last exchange of an executed plan dealt out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.nodeName() != "Exchange":
        node = node.children().apply(0)
    return node.metrics().get("dataSize").get().value()


def test_texts_are_moved_in_runs(spark):
    """What goes to the groupings grows with the texts, not with a record for every word."""
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(400)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    vocab = S.vocabulary(df, "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        arrays = S.id_arrays(S.encode(S.token_rows(df, ["id"], {"text": "text"}), vocab), ["id"], ["text"])
        ids = arrays.collect()
        assert _moved(arrays) < 6 * 400 * 300
        given = spark.createDataFrame(ids, arrays.schema).withColumnRenamed("text", "ids").repartition(2)
        decoded = S.decode(given, vocab, ["id"], "ids")
        assert _moved(decoded) < 2 * sum(len(t) for t in texts)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r.text for r in decoded.orderBy("id").collect()] == texts


@pytest.mark.parametrize("head", [0, 2, 100])
def test_rows_of_equal_keys_are_one_text(spark, head):
    df = spark.createDataFrame(
        [(1, "b c b"), (1, "a c d e"), (None, "b"), (None, "a b"), (2, None), (2, "c")], "id int, text string"
    ).coalesce(1)
    vocab = S.vocabulary(df, "text")
    of = {r.token: r.token_id for r in vocab.collect()}
    encoded = S.encode(S.token_rows(df, ["id"], {"text": "text", "turned": F.reverse("text")}), vocab, head)
    arrays = S.id_arrays(encoded, ["id"], ["text", "turned"])
    texts = {1: ["a b", "c c", "b d", "e"], None: ["a b", "b"], 2: ["c"]}
    turned = {1: ["b e", "c d", "b c", "a"], None: ["b b", "a"], 2: ["c"]}
    in_order = lambda parts: [i for p in parts for i in sorted(of[w] for w in p.split())]
    found = {r.id: (r.text, r.turned) for r in arrays.collect()}
    assert found == {k: (in_order(texts[k]), in_order(turned[k])) for k in texts}
    ids = df.select("id", F.transform(S.words("text"), lambda w: F.lit(0)).alias("ids"))  # only special ids
    assert {r.id: r.text for r in S.decode(ids, vocab, ["id"], "ids", head=head).collect()} == {1: "", 2: "", None: ""}
    rows = [(1, [of[w] for w in "b c b".split()]), (1, [of[w] for w in "a c d e".split()]), (2, None), (2, [of["c"]])]
    decoded = S.decode(spark.createDataFrame(rows, "id int, ids array<int>"), vocab, ["id"], "ids", head=head)
    assert {r.id: r.text for r in decoded.collect()} == {1: "a b c c b d e", 2: "c"}
