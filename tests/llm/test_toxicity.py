import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from invented import prose
from hypothesis import given
from hypothesis import strategies as st

from caseloom.llm import samples, toxicity
from caseloom.llm.toxicity import EXACT, MISSPELLED, NONE, Automaton, Lexicon

LEXICON = Lexicon(("abab", "ababa", "bbaab", "aabbaabbaa"), ("bbbb",))


@given(st.text("ab", max_size=13))
def test_automaton_equals_distances(word):
    if word.startswith("bbbb"):
        wanted = EXACT
    elif word in LEXICON.words:
        wanted = EXACT
    elif any(toxicity._within(word, t, LEXICON.edits(t)) for t in LEXICON.words):
        wanted = MISSPELLED
    else:
        wanted = NONE
    assert Automaton(LEXICON)(word) == wanted


def test_exact_only_words_take_no_edits():
    found = Automaton(Lexicon(("idiot",), (), frozenset(["idiot"])))
    assert found("idiot") == EXACT and found("idiott") == NONE and found("") == NONE


def test_context_separates_quotation_from_abuse():
    texts = ['he called them "idiots" and an idiot again', "you are an idiot", "so it goes, idiott"]
    counts = toxicity.hit_counts(pa.array(texts), Automaton(Lexicon(("idiot", "idiots"), ())))
    assert counts[0, 2] == 2 and counts[0, 0] == 0
    assert counts[1, 0] == 1 and counts[1, 3] == 1 and counts[1, 2] == 0
    assert counts[2, 1] == 1


def brute(text, lexicon):
    """Every word against every term by edit distance, contexts cut out of the split text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def kind(core):
        if core in lexicon.words or core.startswith(lexicon.beginnings):
            return EXACT
        return MISSPELLED if any(distance(core, t) <= lexicon.edits(t) for t in lexicon.words) else NONE

    counts = [0, 0, 0, 0]
    hits = 0
    for i, word in enumerate(words):
        kinds = {kind(core) for core in re.findall(r"\w+", word.lower())} - {NONE}
        if not kinds:
            continue
        hits += 1
        before, after = words[max(i - 8, 0) : i + 1], words[i : i + 9]
        cores = {c for w in before + after for c in re.findall(r"\w+", w.lower())}
        marks = any(w[0] in toxicity.QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in toxicity.QUOTES for w in after if w.rstrip(".,;:!?"))
        quoted = marks or bool(cores & toxicity.REPORTING)
        counts[2 if quoted else 0 if EXACT in kinds else 1] += 1
        counts[3] += bool(cores & toxicity.AIMED)
    return [*counts, hits / max(len(words), 1)]


@cache
def distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    if a[0] == b[0]:
        return distance(a[1:], b[1:])
    return 1 + min(distance(a[1:], b), distance(a, b[1:]), distance(a[1:], b[1:]))


def test_scores_equal_brute_force(make, edge_rows):
    lexicon = Lexicon(("idiot", "scumbag", "dumbheaded", "fool"), ("grumb",), frozenset(["scumbag"]))
    weights = (0.7, -0.3, -0.9, 0.4, 1.1, 1.3, -0.2, -2.0)
    rng = random.Random(4)
    odd = ["idiot", "Idoit", "idioot.", "scumbag!", "scumbagg", "dumheadd", "dumbheadedly", "grumbler", "“fool”", "fol", "you", "said",
           '"idiot', 'x"', "tu", "«", "»", "...", "fool-idoit", "grumb"]
    texts = [" ".join(rng.choice(odd if rng.random() < 0.3 else prose(i, 9).split()) for _ in range(i)) for i in range(60)]
    texts += [t and t[:4000] for _, t in edge_rows]
    model = toxicity.Model(lexicon, weights)
    for r in toxicity.score(make(list(enumerate(texts))), model).collect():
        wanted = brute(texts[r.doc_id], lexicon)
        assert [r[f] for f in toxicity.FEATURES] == pytest.approx(wanted), texts[r.doc_id]
        exact, misspelled, quoted, aimed, density = wanted
        inputs = [*(math.log1p(v) for v in (exact + misspelled, misspelled, quoted, aimed)), min(density * 20, 1)]
        inputs += [exact + misspelled > 0, misspelled > 0, 1]
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(inputs, weights))))
        assert abs(r.score - score) < 1e-9 and r.predicted == (r.score >= 0.5)


@pytest.fixture(scope="module")
def model(spark, make):
    rows = [(i, prose(i, 50) + (" dumbhead scumbag" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(200)] + [(0, None, 1)], "doc_id bigint, toxic int, text int")
    sample = samples.labelled_texts(make(rows, extra=True), labels, "toxic", labels.doc_id >= 0)
    return toxicity.learn(sample)


def test_learned_words(model):
    assert set(model.lexicon.words) >= {"dumbhead", "scumbag"}


def test_scores(make, model, edge_rows):
    toxic = [(50, "a dumbhead"), (51, "the Dumbheadd, over there"), (52, prose(5, 3000) + " scumbag.")]
    found = toxicity.score(make(edge_rows + toxic, extra=True), model).collect()
    assert len(found) == len(edge_rows) + 3
    assert {r.doc_id for r in found if r.predicted} == {50, 51, 52}
    assert all(0 <= r.score <= 1 for r in found)
    kept = toxicity.accepted(make(edge_rows + toxic, extra=True), model)
    assert kept.count() == len(edge_rows) and "tie" in kept.columns


def test_empty_tables(spark, make):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.learn(samples.labelled_texts(make([(1, "x")]), labels, "toxic", labels.doc_id >= 0))
    row = toxicity.score(make([(1, "x")]), model).first()
    assert row.predicted == 0 and np.isfinite(row.score)
    assert toxicity.score(make([]), model).count() == 0


def test_held_out_accuracy(spark):
    from caseloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = samples.one_label(spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    held = QUERIES["op5_toxicity"](spark, folder).where("held_out").join(labels, "doc_id")
    assert held.where("label = predicted").count() >= 0.9 * held.count()
    clean = held.where("label = 0")
    assert clean.where("predicted = 1").count() <= 0.02 * clean.count()


def test_words_under_a_beginning_keep_their_misspellings(spark):
    family = ["grumblefoo", "grumblebar", "grumblequx"]
    rows = [(i, f"{prose(i, 30)} {family[i % 3]} {prose(100 + i, 10)}", 1) for i in range(45)]
    rows += [(100 + i, prose(200 + i, 40), 0) for i in range(150)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    lexicon = toxicity.learn_lexicon(sample)
    assert {*family} <= {*lexicon.words} and any("grumble".startswith(b) for b in lexicon.beginnings)
    automaton = toxicity.Automaton(lexicon)
    for word in ("gumblefoo", "grrumblebar", "gxumblequx"):
        assert automaton(word) == toxicity.MISSPELLED
    assert automaton("grumbleanything") == toxicity.EXACT
    few = toxicity.learn_lexicon(sample, terms=2)
    assert len(few.words) <= 2 and len(few.beginnings) <= 2
    assert toxicity.learn_lexicon(sample, candidates=1).words + toxicity.learn_lexicon(sample, candidates=1).beginnings != ()
