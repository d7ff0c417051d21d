import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.operators import subwords
from caseloom.operators.subwords import END


def plain_merges(counts, merges, least=2):
    """One pair at a time."""
    table = {w: [*w, END] for w in counts if w}
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, s in table.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        pairs = {p: n for p, n in pairs.items() if n >= least}
        if not pairs:
            break
        pair = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((*pair, pairs[pair]))
        for w, s in table.items():
            i, new = 0, []
            while i < len(s):
                two = tuple(s[i : i + 2]) == pair
                new.append(s[i] + s[i + 1] if two else s[i])
                i += 1 + two
            table[w] = new
    return out, table


@pytest.fixture
def words(spark):
    return lambda counts: spark.createDataFrame(list(counts.items()), "word string, n bigint")


def learned(df, merges, **options):
    return [tuple(r)[1:] for r in subwords.learn_merges(df, merges, **options).orderBy("rank").collect()]


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abcdefghij"), (3, "a$\\.é日(")])
def test_merges_equal_one_at_a_time(words, seed, alphabet):
    rng = random.Random(seed)
    counts = Counter("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(120))
    counts = {w: n * rng.randint(1, 50) for w, n in counts.items()}
    assert learned(words(counts), 60) == plain_merges(counts, 60)[0]


def test_merges_of_separate_symbols_share_a_round(words):
    counts = {"ab": 100, "cd": 90, "ef": 80, "gh": 70}
    table = subwords.stored(words(counts).select("n", subwords._symbols(subwords.F.col("word")).alias("symbols")), "t")
    assert [m[:2] for m in subwords._round(table, 2)][:1] == [("a", "b")]
    assert learned(words(counts), 8) == plain_merges(counts, 8)[0]


def test_edges_of_learning(spark, words):
    rows = [("aaaa", 3), ("aaaa", 2), (None, 5), ("", 7), ("bb", None), (f"x{END} y", 4)]
    df = spark.createDataFrame(rows, "word string, n bigint").selectExpr("*", "1 AS symbols", "2 AS left")
    counts = {"aaaa": 5, f"x{subwords.REPLACED * 2}y": 4}
    assert learned(df, 20) == plain_merges(counts, 20)[0]
    assert learned(words({"ab": 1}), 5) == [] and learned(words({}) if False else words({"a": 1}).where("n > 1"), 5) == []
    assert learned(words({"abab": 9, "xy": 3}), 9, least=5) == plain_merges({"abab": 9, "xy": 3}, 9, 5)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé ", min_size=1, max_size=8), min_size=1, max_size=12))
def test_encoder_applies_merges_in_order(texts):
    counts = Counter(w for t in texts for w in t.split())
    merges, table = plain_merges(counts, 15)
    encoder = subwords.Encoder(subwords.Subwords(tuple(m[:2] for m in merges), ()))
    assert {w: encoder.split(w) for w in counts} == {w: s for w, s in table.items()}


@pytest.fixture
def known(spark, words):
    texts = ["the lower the lowest", "new newer newest widest", "low low low"]
    counts = Counter(w for t in texts for w in t.split())
    return subwords.subwords(words(counts), subwords.learn_merges(words(counts), 12))


def test_round_trip_padding_and_cuts(spark, known):
    texts = ["the  lowest\n newest", "", None, " ", "low", "unseen Q", f"low{END}er", "the " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "5 AS `a.b`", "6 AS ids")
    whole = subwords.encode_subwords(df, "text", known, ["id", "a.b"])
    back = {r.id: r.text for r in subwords.decode_subwords(whole, "ids", known).collect()}
    assert back[0] == "the lowest newest" and back[4] == "low" and back[7] == ("the " * 500).strip()
    assert back[1] == back[2] == back[3] == "" and "Q" not in back[5] and subwords.REPLACED in back[5]
    cut = {r.id: r for r in subwords.encode_subwords(df, "text", known, ["id"], max_len=6, pad=True).collect()}
    full = {r.id: r for r in whole.collect()}
    for i, r in cut.items():
        assert len(r.ids) == 6 and r.n_subwords == len(full[i].ids) - 1 == full[i].n_subwords
        assert r.truncated == (r.n_subwords > 5) and not full[i].truncated
        assert r.ids[: min(5, r.n_subwords)] == full[i].ids[: min(5, r.n_subwords)]
        assert r.ids[min(5, r.n_subwords)] == 1 and set(r.ids[r.n_subwords + 1 :]) <= {0}
    bare = subwords.encode_subwords(df, "text", known, ["id"], end_id=None).where("id = 1").first()
    assert bare.ids == [] and subwords.encode_subwords(df.where("id < 0"), "text", known, ["id"]).count() == 0


def test_word_counts_and_ids(spark, known):
    df = spark.createDataFrame([("a b\ta",), (None,), ("",), (" b ",)], "text string")
    assert {r.word: r.n for r in subwords.word_counts(df, "text").collect()} == {"a": 2, "b": 2}
    assert len(set(known.symbols)) == len(known.symbols) and END in known.symbols


def test_many_words_are_encoded_as_one_at_a_time():
    """Equal symbols, symbols made in two ways and characters never seen included; a merge costs no pass of its own."""
    import random

    draw = random.Random(5)
    for _ in range(200):
        symbols, merges = [*"abcé", subwords.END], []
        for _ in range(draw.randrange(12)):
            merges.append((draw.choice(symbols), draw.choice(symbols)))
            symbols.append("".join(merges[-1]))
        encoder = subwords.Encoder(subwords.Subwords(tuple(merges), tuple(dict.fromkeys(symbols))))
        words = ["", *("".join(draw.choices("aabcé😀", k=draw.randrange(1, 12))) for _ in range(40))]
        ids, sizes = encoder.many(words)
        assert sizes.tolist() == [len(encoder(w)) if w else 0 for w in words]
        assert ids.tolist() == [i for w in words if w for i in encoder(w)]
    assert [a.tolist() for a in encoder.many([])] == [[], []]


@pytest.mark.parametrize("pieces, pairs, few", [(25, 12, 3), (4, 1000, 0), (60, 40, 1000)])
def test_rounds_on_pieces_equal_one_at_a_time(words, monkeypatch, pieces, pairs, few):
    """However little the driver holds, equally frequent pairs and repeated characters included."""
    for name, value in (("PIECES", pieces), ("FREQUENT_PAIRS", pairs), ("FEW_MERGES", few)):
        monkeypatch.setattr(subwords, name, value)
    rng = random.Random(pieces)
    counts = Counter("".join(rng.choice("aab$é😀") for _ in range(rng.randint(1, 7))) for _ in range(60))
    counts = {w: n * rng.randint(1, 9) for w, n in counts.items()}
    assert learned(words(counts), 40) == plain_merges(counts, 40)[0]


def test_audit_learns_a_whole_vocabulary(spark, tmp_path):
    """Merges until no pair occurs twice: sizes of texts are those after one merge at a time."""
    from caseloom.plans.queries import QUERIES

    rng = random.Random(3)
    known = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    texts = [" ".join(rng.choices(known, k=rng.choice([5, 50, 400]))) for _ in range(12)] + ["", None, "once"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    merges, table = plain_merges(Counter(w for t in texts for w in (t or "").split()), 32_000)
    assert len(merges) > 30
    wanted = {i: sum(len(table[w]) for w in (t or "").split()) for i, t in enumerate(texts)}
    found = QUERIES["subword_audit"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_subwords for r in found} == wanted
    assert all(r.truncated == (wanted[r.doc_id] > 511) for r in found) and len(found) == len(texts)
