"""Toxicity scores from a lexicon, misspellings included, and the context of its hits.

The lexicon is learned: words, and beginnings of words, that labelled toxic documents
hold far more often than others. A trie of the lexicon is intersected with Levenshtein
automata of its terms, so one walk along a word finds exact and misspelled terms.
Around every hit a window of words tells whether the term is quoted or aimed at
somebody. Counts of hits by kind and context are the inputs of a logistic score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.session import stored

TERMS = 512  # words, and beginnings, of a learned lexicon at most
CANDIDATES = 20_000  # terms of the labelled sample whose counts are compared, at most
LEAST_DOCUMENTS = 4  # toxic documents that hold a term, at least
LEAST_ODDS = 8.0  # how much likelier a term is in toxic documents, at least
LEAST_GAIN = 14.0  # log likelihood gained by a term's own share of toxic documents, at least
ORDINARY_SHARE = 0.001  # of other documents with a term's misspellings: it gets no edits then
PREFIXES = range(4, 8)  # lengths of beginnings that may become terms
LIMIT = 0.5  # texts that score so much are toxic
WINDOW = 8  # words of context on each side
_WORD = re.compile(r"\w+")
# Marks and words that surround a quoted or an aimed term.
QUOTES = frozenset("\"“”„«»‹›")
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote word words dit disait écrit mot sagte sagt schrieb wort "
    "dijo dice escribió palabra".split()
)
AIMED = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi vous tú ti usted ustedes".split())
NONE, EXACT, MISSPELLED = 0, 1, 2


def allowed_edits(term: str) -> int:
    """Short terms have too many neighbours to be taken misspelled."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...]
    beginnings: tuple[str, ...]
    exact_only: frozenset[str] = frozenset()  # words whose neighbours are ordinary words

    def edits(self, word: str) -> int:
        return 0 if word in self.exact_only else allowed_edits(word)


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    edits: int = -1  # allowed for the word that ends here; -1: none does
    reach: int = 0  # most edits of any word below
    beginning: bool = False


class Automaton:
    """Trie of the lexicon intersected with the Levenshtein automata of its words.

    A state is the set of trie nodes that the letters read so far may lead to, each with
    the fewest edits. States and steps are made when first needed and then kept.
    """

    def __init__(self, lexicon: Lexicon):
        self.nodes = [_Node()]
        for word in lexicon.words:
            node = self._path(word, lexicon.edits(word))
            node.edits = lexicon.edits(word)
        for word in lexicon.beginnings:
            self._path(word, 0).beginning = True
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[int] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._number(self._closed({0: 0}))

    def _path(self, word: str, reach: int) -> _Node:
        at = 0
        for c in word:
            self.nodes[at].reach = max(self.nodes[at].reach, reach)
            if c not in self.nodes[at].children:
                self.nodes[at].children[c] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].children[c]
        self.nodes[at].reach = max(self.nodes[at].reach, reach)
        return self.nodes[at]

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Add what is reached by leaving out letters of a term."""
        waiting = list(state.items())
        while waiting:
            at, edits = waiting.pop()
            for child in self.nodes[at].children.values():
                if edits + 1 <= self.nodes[child].reach and state.get(child, 99) > edits + 1:
                    state[child] = edits + 1
                    waiting.append((child, edits + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        """0 is the dead state's number in steps; live states count from 1."""
        if not state:
            return 0
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.states.append(state)
            self.steps.append({})
            best = min((e for n, e in state.items() if e <= self.nodes[n].edits), default=None)
            self.verdicts.append(NONE if best is None else EXACT if best == 0 else MISSPELLED)
            self.numbers[key] = len(self.states)
        return self.numbers[key]

    def _step(self, number: int, c: str) -> int:
        """The next state; -1 when a listed beginning is complete."""
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.nodes[node].reach and out.get(node, 99) > edits:
                out[node] = edits

        for at, edits in self.states[number - 1].items():
            reach(at, edits + 1)  # a letter too many
            for letter, child in self.nodes[at].children.items():
                reach(child, edits + (letter != c))
        if any(edits == 0 and self.nodes[node].beginning for node, edits in out.items()):
            next_state = -1
        else:
            next_state = self._number(self._closed(out))
        self.steps[number - 1][c] = next_state
        return next_state

    def __call__(self, word: str) -> int:
        """Whether the word is a term, a misspelled one, or none."""
        state = self.start
        for c in word:
            following = self.steps[state - 1].get(c)
            state = self._step(state, c) if following is None else following
            if state <= 0:
                return EXACT if state else NONE
        return self.verdicts[state - 1]


def _cores(unique: pa.Array) -> list[list[str]]:
    """Lower-case runs of letters and digits of each different word."""
    return [_WORD.findall(w.lower()) for w in unique.cast(pa.large_string()).to_numpy(zero_copy_only=False)]


def _terms(core: str) -> Iterable[str]:
    """The word, and its beginnings marked by a star."""
    if len(core) >= 3:
        yield core
    for n in PREFIXES:
        if len(core) > n:
            yield core[:n] + "*"


def _document_counts(sample: DataFrame, wanted: set[str] | None) -> DataFrame:
    """In how many toxic and other documents each term occurs: term, toxic, clean.

    Without ``wanted`` only toxic documents are read. Counts are summed per slice first.
    """
    names, schema = ["term", "toxic", "clean"], "term string, toxic bigint, clean bigint"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = arrow.words(batch.column("text"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        number: dict[str, int] = {}
        terms_of = [
            [number.setdefault(t, len(number)) for core in cores for t in _terms(core) if wanted is None or t in wanted]
            for cores in _cores(w.unique)
        ]
        lengths = np.array([len(t) for t in terms_of], np.int64)
        flat = np.array([t for terms in terms_of for t in terms], np.int64)
        begin = np.cumsum(lengths) - lengths
        n = lengths[w.ids]
        at = np.repeat(begin[w.ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = np.unique(np.repeat(w.doc, n) * np.int64(len(number) or 1) + flat[at])
        doc, term = np.divmod(pairs, len(number) or 1)
        toxic = np.bincount(term[label[doc] == 1], minlength=len(number))
        clean = np.bincount(term[label[doc] != 1], minlength=len(number))
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(toxic), pa.array(clean)], names)

    read = sample.where("label = 1") if wanted is None else sample
    parts = read.select("text", "label").mapInArrow(arrow.per_slice(rows), schema)
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, terms: int = TERMS, candidates: int = CANDIDATES) -> Lexicon:
    """Terms that toxic documents of a bounded sample (text, label) hold far more often.

    A beginning becomes a term only when it stands for several words; these words stay
    in the lexicon for their misspellings. At most ``terms`` words and as many beginnings
    (those with the highest odds) are kept, out of the ``candidates`` that most toxic
    documents hold. Without documents of both kinds the lexicon is empty.
    """
    size = dict(sample.groupBy("label").count().collect())
    n_toxic, n_clean = size.get(1, 0), sum(n for label, n in size.items() if label != 1)
    often = _document_counts(sample, None).where(F.col("toxic") >= LEAST_DOCUMENTS)
    wanted = {r.term for r in often.orderBy(F.desc("toxic"), "term").limit(candidates).collect()}
    if not wanted or not n_clean:
        return Lexicon((), ())
    counts = _document_counts(sample, wanted).collect()
    odds = {r.term: (r.toxic + 0.5) / (n_toxic + 1) / ((r.clean + 0.5) / (n_clean + 1)) for r in counts}
    toxic = {r.term: r.toxic for r in counts}
    share = n_toxic / (n_toxic + n_clean)

    def gain(r) -> float:
        n = r.toxic + r.clean
        parts = ((r.toxic, share), (r.clean, 1 - share))
        return sum(k * np.log(k / n / expected) for k, expected in parts if k)

    sure = {r.term for r in counts if gain(r) >= LEAST_GAIN}
    good = sorted((t for t in odds if odds[t] >= LEAST_ODDS and t in sure), key=lambda t: (-odds[t] * toxic[t] ** 0.5, t))
    words = [t for t in good if not t.endswith("*")]
    single = Counter()  # toxic documents of a beginning's most frequent word
    for word in toxic:
        if not word.endswith("*"):
            for n in PREFIXES:
                single[word[:n]] = max(single[word[:n]], toxic[word])
    beginnings: list[str] = []
    for term in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if toxic[term + "*"] >= 1.5 * single[term] and not any(term.startswith(b) for b in beginnings):
            beginnings.append(term)
    return Lexicon(tuple(words[:terms]), tuple(sorted(beginnings, key=lambda b: (-odds[b + "*"], b))[:terms]))


def _within(word: str, term: str, edits: int) -> bool:
    """Whether the distance of two words is at most ``edits``."""
    if abs(len(word) - len(term)) > edits:
        return False
    row = list(range(len(term) + 1))
    for i, c in enumerate(word, 1):
        last, row = row, [i]
        for j, d in enumerate(term, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
    return row[-1] <= edits


def drop_ordinary_neighbours(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Allow no edits to words whose misspellings the documents that are not toxic hold, too."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, counts = Automaton(sent.value), Counter()
        w = arrow.words(batch.column("text"))
        pairs = np.unique(w.ids * np.int64(len(w.bounds)) + w.doc) // len(w.bounds)
        documents = np.bincount(pairs, minlength=len(w.unique)).tolist()
        for n, cores in zip(documents, _cores(w.unique)):
            for core in cores:
                if automaton(core) == MISSPELLED:
                    counts.update({t: n for t in sent.value.words if _within(core, t, sent.value.edits(t))})
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
        )

    clean = sample.where("label = 0")
    least = max(2, clean.count() * ORDINARY_SHARE)
    found = clean.select("text").mapInArrow(arrow.per_slice(rows), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    ordinary = frozenset(r.term for r in found.where(F.col("n") >= least).collect())
    return Lexicon(lexicon.words, lexicon.beginnings, ordinary)


FEATURES = ("exact", "misspelled", "quoted", "aimed", "density")


def _context(words: list[str], place: int) -> tuple[bool, bool]:
    """Whether a hit is quoted, and whether it is aimed at somebody."""
    around = words[max(place - WINDOW, 0) : place + WINDOW + 1]
    here = min(place, WINDOW)
    before = any(q in QUOTES for w in around[: here + 1] for q in w[:1])
    after = any(q in QUOTES for w in around[here:] for q in w.rstrip(".,;:!?")[-1:])
    plain = {c for w in around for c in _WORD.findall(w.lower())}
    return (before and after) or bool(plain & REPORTING), bool(plain & AIMED)


def hit_counts(texts: pa.Array, automaton: Automaton) -> np.ndarray:
    """Numbers of exact and misspelled hits, of quoted and aimed ones, and hits per word."""
    w = arrow.words(texts)
    n = len(w.bounds) - 1
    known: dict[str, int] = {}
    kind = np.zeros(len(w.unique), np.int8)
    for i, cores in enumerate(_cores(w.unique)):
        for core in cores:
            if (found := known.get(core)) is None:
                found = known[core] = automaton(core)
            if found and (kind[i] == NONE or found == EXACT):
                kind[i] = found
    kind = kind[w.ids]
    hits = np.flatnonzero(kind)
    doc = np.searchsorted(w.bounds, hits, "right") - 1
    quoted, aimed = np.zeros(len(hits), bool), np.zeros(len(hits), bool)
    for i, (hit, d) in enumerate(zip(hits.tolist(), doc.tolist())):
        a, b = max(hit - WINDOW, int(w.bounds[d])), min(hit + WINDOW + 1, int(w.bounds[d + 1]))
        near = w.unique.take(pa.array(w.ids[a:b])).cast(pa.large_string()).to_pylist()
        quoted[i], aimed[i] = _context(near, hit - a)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.bincount(doc[(kind[hits] == EXACT) & ~quoted], minlength=n)
    out[:, 1] = np.bincount(doc[(kind[hits] == MISSPELLED) & ~quoted], minlength=n)
    out[:, 2] = np.bincount(doc[quoted], minlength=n)
    out[:, 3] = np.bincount(doc[aimed], minlength=n)
    out[:, 4] = np.bincount(doc, minlength=n) / np.maximum(np.diff(w.bounds), 1)
    return out


def _inputs(counts: np.ndarray) -> np.ndarray:
    """Columns of the logistic score: damped counts, whether there is any, and one.

    Misspelled hits count with the exact ones and once more on their own, so without
    labelled examples they weigh the same.
    """
    all_hits = counts[:, 0] + counts[:, 1]
    damped = np.log1p(np.column_stack([all_hits, counts[:, 1:4]]))
    some = np.column_stack([all_hits, counts[:, 1]]) > 0
    return np.column_stack([damped, np.minimum(counts[:, 4] * 20, 1), some, np.ones(len(counts))])


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the penalty keeps weights finite when the classes are separable."""
    weights = np.zeros(x.shape[1])
    penalty = np.full(len(weights), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learn(sample: DataFrame, terms: int = TERMS, candidates: int = CANDIDATES) -> Model:
    """Lexicon and weights from a bounded sample with columns doc_id, text and label.

    ``terms`` and ``candidates`` bound the lexicon, see ``learn_lexicon``.
    """
    sample = stored(sample, "labelled")
    lexicon = drop_ordinary_neighbours(sample, learn_lexicon(sample, terms, candidates))
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = hit_counts(batch.column("text"), Automaton(sent.value))
        columns = [batch.column("label"), *(pa.array(c) for c in counts.T.copy())]
        return pa.RecordBatch.from_arrays(columns, ["label", *FEATURES])

    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = sample.select("text", "label").mapInArrow(arrow.per_slice(rows), schema).toArrow()
    if not table.num_rows:
        return Model(lexicon, (0.0,) * (len(FEATURES) + 2) + (-10.0,))
    counts = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
    # rows in a fixed order: sums must not depend on which task was first
    label = (table.column("label").to_numpy() == 1).astype(float)
    order = np.lexsort((label, *counts.T))
    return Model(lexicon, tuple(_logistic(_inputs(counts[order]), label[order]).tolist()))


def _scores(counts: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(counts) @ np.array(model.weights), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Toxicity of every document: doc_id, score (0 to 1), the hit counts, predicted.

    One pass without any exchange; whole texts. A null or empty text has no hits and the
    score of such texts. Repeated rows come back as often as given, a null doc_id stays
    null, other columns are ignored. An empty lexicon gives every text the same score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", *FEATURES]

    def run(batches):
        automaton = Automaton(sent.value.lexicon)
        for batch in arrow.sliced(batches):
            counts = hit_counts(batch.column("text"), automaton)
            columns = [batch.column("doc_id"), pa.array(_scores(counts, sent.value)), *(pa.array(c) for c in counts.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, score double, " + ", ".join(f"{f} double" for f in FEATURES)
    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores below LIMIT; as for ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        automaton = Automaton(sent.value.lexicon)
        for batch in arrow.sliced(batches):
            counts = hit_counts(batch.column("text"), automaton)
            yield batch.filter(pa.array(_scores(counts, sent.value) < LIMIT))

    return arrow.filtered(docs, run)
