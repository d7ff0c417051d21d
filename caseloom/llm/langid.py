"""Language identification by compression.

For every language a zstandard raw-content dictionary is made of training text. A text
belongs to the language whose dictionary compresses it best. Texts are compressed in
short pieces that cannot learn from each other, so that the dictionary counts however
long the text is. A prediction whose two smallest sizes are too close is marked rejected.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.session import stored

UNKNOWN = "und"
SAMPLE_TEXTS = 64  # training texts per language at most
SAMPLE_CHARS = 4096  # of a training text at most, in windows from all over it
WINDOW_CHARS = 512
LANGUAGES = 512  # dictionaries at most, of the most frequent languages: bounds what is sent to the tasks
PIECE_BYTES = 2048
LEVEL = 6  # lower levels overlook short matches with the dictionary
SHARPNESS = 60.0  # turns a relative size difference into odds
MARGIN = 0.01  # smaller relative differences are rejected
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters, one blank between; case and signs tell no language."""
    return _OTHER.sub(" ", text.lower()).strip()


def windows(text: str, seed: int, chars: int) -> str:
    """The text, or windows from all its parts (one in each, at a place the seed chooses) of ``chars`` in all."""
    if len(text) <= chars:
        return text
    size = min(WINDOW_CHARS, chars)
    parts = chars // size
    out = []
    for i in range(parts):
        a, b = len(text) * i // parts, len(text) * (i + 1) // parts
        at = a + (seed + i * 0x9E3779B1) % max(b - a - size + 1, 1)
        out.append(text[at : at + size])
    return " ".join(out)


def learn(
    labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES
) -> dict[str, bytes]:
    """Dictionary content of each language, from columns text and lang; most frequent first.

    The sample is bounded: per language the ``texts`` texts with the smallest hashes, of
    each at most ``chars`` characters in windows from all its parts. Of more than
    ``languages`` different values of lang the most frequent are learned (ties: least
    name). Each task keeps only its own smallest hashes, so a language with most of all
    rows is no large group. Rows without language or letters are left out; equal texts
    count once; an empty table teaches no language.
    """

    def smallest(batches):
        best: dict[str, dict[int, str]] = {}
        for batch in batches:
            order = ("lang", "rank", "text")
            for lang, rank, text in zip(*(batch.column(c).to_pylist() for c in order)):
                held = best.setdefault(lang, {})
                if rank in held or (len(held) >= texts and rank >= max(held)):
                    continue
                if clean := windows(letters(text), rank, chars):
                    held[rank] = clean
                    if len(held) > texts:
                        del held[max(held)]
        rows = [(lang, rank, text) for lang, held in best.items() for rank, text in held.items()]
        columns = list(zip(*rows)) if rows else [[], [], []]
        types = pa.string(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "rank", "text"])

    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    ranked = known.select("lang", F.xxhash64("text").alias("rank"), "text")
    few = ranked.mapInArrow(smallest, "lang string, rank bigint, text string").dropDuplicates(["lang", "rank"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    sample = stored(few.withColumn("place", place).where(F.col("place") <= texts).drop("place"), "sample")
    # the most frequent language first: it gets texts that all compress alike
    counts = known.groupBy("lang").count().join(sample.select("lang").distinct(), "lang", "left_semi")
    order = [r.lang for r in counts.orderBy(F.desc("count"), "lang").limit(languages).collect()]
    held: dict[str, list[str]] = {lang: [] for lang in order}
    for row in sample.where(F.col("lang").isin(order)).orderBy("lang", "rank").collect():
        held[row.lang].append(row.text)
    return {lang: "\n".join(kept).encode() for lang, kept in held.items()}


def _compressors(content: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, raw in content:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False))
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL) -> DataFrame:
    """Language of every document: doc_id, lang_pred, score, margin, rejected.

    ``margin`` is how much smaller the best size is than the second, in parts of the
    second; ``rejected`` marks margins below MARGIN. ``score`` is the share of the best
    language's odds, 0 to 1.

    A null text, or one without a letter, is ``und`` with score 0, rejected; so is every
    text when no language was learned. Equal sizes go to the language
    named first in ``dictionaries``. Repeated rows come back as often as given; other columns are ignored. One
    pass without any exchange; whole texts.
    """
    content = tuple(dictionaries.items())
    names = [lang for lang, _ in content]
    sent = docs.sparkSession.sparkContext.broadcast(content)
    key = "compressors", uuid.uuid4().hex

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressors = arrow.held(key, lambda: _compressors(sent.value, level))
        lang, score, margin = [], [], []
        for text in pc.fill_null(batch.column("text"), "").to_pylist():
            clean = letters(text).encode()
            if not clean or not compressors:
                lang.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                continue
            pieces = [clean[i : i + PIECE_BYTES] for i in range(0, len(clean), PIECE_BYTES)]
            sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], float)
            best = int(sizes.argmin())
            odds = np.exp(-SHARPNESS * (sizes - sizes[best]) / sizes[best])
            lang.append(names[best])
            score.append(float(1 / odds.sum()))
            second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
            margin.append(float(1 - sizes[best] / second))
        columns = [
            batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
            pa.array(margin, pa.float64()), pa.array([m < MARGIN for m in margin], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    schema = "doc_id bigint, lang_pred string, score double, margin double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(arrow.per_slice(rows), schema)
