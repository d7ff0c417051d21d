import pytest
import zstandard
from invented import prose

from caseloom.llm import langid

GERMAN = "der schnelle braune fuchs springt über den faulen hund und zwei alte türme stehen am fluss bei nacht".split()


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(prose(i, 120), "en") for i in range(30)]
    rows += [(" ".join(GERMAN[(i * 7 + j * j) % len(GERMAN)] for j in range(120)), "de") for i in range(10)]
    rows += [(None, "de"), ("12 34", "fr"), ("text", None)] + [rows[0]] * 20
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_learns_only_languages_with_letters(learned):
    assert list(learned) == ["en", "de"]
    assert len(learned["en"]) <= langid.SAMPLE_TEXTS * (langid.SAMPLE_CHARS + 1)


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(prose(i, 120), "en") for i in range(40)]
    first = langid.learn(spark.createDataFrame(rows, "text string, lang string"), texts=3, chars=50)
    again = langid.learn(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(5), texts=3, chars=50)
    assert first == again and len(first["en"]) <= 3 * 51


def test_windows_come_from_all_parts_of_a_text():
    text = "".join(chr(97 + i // 1000) for i in range(26_000))
    for seed in (0, 1, -5, 2**62):
        found = langid.windows(text, seed, 4096)
        assert len(found) <= 4096 + 8 and len(set(found) - {" "}) >= 8
        # one window in each eighth of the text
        assert [text.index(w[0]) * 8 // 26_000 in (i - 1, i) for i, w in enumerate(found.split(" "))] == [True] * 8
    assert langid.windows("short", 3, 4096) == "short"


def test_the_most_frequent_languages_are_learned(spark):
    rows = [(prose(i * 7 + n, 20), f"l{i}") for i in range(6) for n in range(6 - i)]
    found = langid.learn(spark.createDataFrame(rows, "text string, lang string"), languages=3)
    assert list(found) == ["l0", "l1", "l2"]


def test_predictions(make, learned):
    english, german = prose(99, 40), "Über den alten Fluss springt der braune Hund und die Türme stehen."
    rows = [(1, english), (2, german), (3, english.upper() + "$$$"), (4, None), (5, ""), (6, "12 ... !"), (None, german),
            (2, german), (7, german * 3000)]
    found = langid.predict(make(rows, extra=True), learned).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [by_id[i].lang_pred for i in (1, 2, 3, 7, None)] == ["en", "de", "en", "de", "de"]
    assert {by_id[i].lang_pred for i in (4, 5, 6)} == {"und"} and by_id[4].score == 0 and by_id[4].rejected
    assert all(0 <= r.score <= 1 for r in found) and not by_id[2].rejected


def brute(text, dictionaries):
    """Sizes of one text under fresh compressors, one for each piece and language."""
    clean = " ".join("".join(c if c.isalnum() and not c.isdecimal() else " " for c in (text or "").lower()).split())
    data = clean.encode()
    if not data:
        return "und", 0.0
    sizes = {}
    for lang, raw in dictionaries.items():
        sizes[lang] = 0
        for i in range(0, len(data), langid.PIECE_BYTES):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=langid.LEVEL)
            one = zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False)
            sizes[lang] += len(one.compress(data[i : i + langid.PIECE_BYTES]))
    best = min(sizes.values())
    return next(n for n, s in sizes.items() if s == best), min([1 - best / s for s in sizes.values() if s > best], default=0.0)


def test_predictions_equal_brute_force(spark, make, edge_rows):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    dictionaries = langid.learn(docs.where("doc_id % 2 = 0").select("text", "lang"), texts=8, chars=1000)
    assert len(dictionaries) == 4
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [t and t[:20_000] for _, t in edge_rows]
    for r in langid.predict(make(list(enumerate(texts))), dictionaries).collect():
        lang, margin = brute(texts[r.doc_id], dictionaries)
        assert r.lang_pred == lang
        if not r.rejected:
            assert abs(r.margin - margin) < 1e-12


def test_narrow_margins_are_rejected(make, spark):
    same = {"a": b"alpha beta gamma", "b": b"alpha beta gamma"}
    row = langid.predict(make([(1, "alpha beta")]), same).first()
    assert row.lang_pred == "a" and row.rejected and row.score == 0.5


def test_nothing_learned(make, spark):
    empty = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert empty == {} and langid.predict(make([(1, "word")]), empty).first().lang_pred == "und"
    assert langid.predict(make([]), {"a": b"x"}).count() == 0


def test_held_out_accuracy(spark):
    from caseloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op4_language_id"](spark, folder).where("held_out").join(lang, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
