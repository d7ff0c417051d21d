import base64
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from invented import prose
from hypothesis import given
from hypothesis import strategies as st

from caseloom.llm import bands


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t#日", max_size=60)), min_size=1, max_size=5))
def test_counts_equal_brute_force(texts):
    found = bands.base_counts(pa.array(texts, pa.string()))
    assert list(zip(*(found[c].tolist() for c in COUNTS))) == [brute(t) for t in texts]


def test_whole_table(make, edge_rows):
    found = bands.quality_rules(make(edge_rows, extra=True)).collect()
    got = sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in found)
    assert got == sorted((str(d), *brute(t)) for d, t in edge_rows)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert bands.quality_rules(make([])).count() == 0


def brute_verdict(text, rules=bands.Bands()):
    """One text at a time: ratio of the whole, ratios of the chunks, limits by length."""
    data = (text or "").encode()

    def size(part):
        return max(len(zstandard.ZstdCompressor(level=rules.level, write_content_size=False).compress(part)), 1)

    def limits(n):
        return [(low, high) for least, low, high in rules.whole if n >= least][-1]

    chunks = [data[i : i + rules.chunk_bytes] for i in range(0, len(data), rules.chunk_bytes)]
    bad = 0
    for chunk in chunks:
        low, high = rules.chunk if len(chunk) == rules.chunk_bytes else limits(len(chunk))
        bad += not low <= len(chunk) / size(chunk) <= high
    ratio, (low, high) = len(data) / size(data), limits(len(data))
    inside = low <= ratio <= high and bad <= rules.bad_chunk_share * len(chunks)
    n_words, *_, n_repeat = brute(text)
    return ratio, n_words >= 10 and 100 * n_repeat <= 20 * n_words and inside


def test_verdicts_equal_brute_force(make, edge_rows):
    folder = "/root/testdata/sf0.001"
    rng = random.Random(8)
    texts = pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist()
    texts += [t for _, t in edge_rows] + ["ab " * 1365 + "c", "ab " * 1365 + "cd", prose(1, 700)[:4096], prose(2, 900)[:4097]]
    texts += [prose(i, 400) + rng.randbytes(2000 * i).hex() + prose(50 + i, 400) for i in range(8)]
    found = bands.quality_rules(make(list(enumerate(texts)))).collect()
    assert len(found) == len(texts) and {r.kept for r in found} == {True, False}
    for r in found:
        ratio, kept = brute_verdict(texts[r.doc_id])
        assert abs(r.ratio - ratio) < 1e-12 and r.kept == kept


def test_bands_reject_repetition_and_noise(make):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=é日本語ñ") for _ in range(40)) for _ in range(60))
    mixed = prose(1, 900) + " ".join(f"x{i % 3}" + "ab" * 30 + f"{i}" for i in range(400))
    lines = "".join(f"row {i} of the same table again and again\n" for i in range(400))
    found = {r.doc_id: r for r in bands.quality_rules(make([(1, noise), (2, lines), (3, mixed)])).collect()}
    assert not found[1].kept and not found[2].kept and not found[3].kept


def test_encoded_text_is_rejected_in_every_band(make):
    rng = random.Random(3)
    rows = []
    for length in (128, 140, 159, 160, 199, 200, 255, 256, 300, 383, 384, 511, 512, 800, 1023, 1024, 1300, 2047, 2048, 4095, 8192, 40_000):
        for width in (8, 11):
            code = base64.b64encode(rng.randbytes(length)).decode()
            rows.append((length, "\n".join(code[i : i + width] for i in range(0, length, width))[:length]))
    found = bands.quality_rules(make(rows)).collect()
    assert not [r for r in found if r.base_failed] and not [(r.doc_id, r.ratio) for r in found if r.kept]


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    good = bands.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id")
    assert good.where("kept").count() >= 0.99 * good.count() > 0
