import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm import linededup


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(holders[key(x)]) >= min_docs and doc < max(holders[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((str(doc), len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def found(docs, **options):
    return sorted((str(r[0]), *r[1:]) for r in linededup.remove_repeated_lines(docs, **options).collect())


LINES = [f"{c} line that many of the documents share" for c in "abcdefgh"] + ["short", "", "  ", "Äb" * 12, "ä" + "Äb" * 12]


def test_edges(make, edge_rows):
    shared = "\t This line stands IN many documents \r"
    rows = edge_rows + [(20 + i, f"{shared}\nonly in {i}\n\n{shared.upper()}") for i in range(5)] + [(21, shared), (None, shared)]
    assert found(make(rows, extra=True)) == brute(rows)
    assert linededup.remove_repeated_lines(make([])).count() == 0
    assert linededup.remove_repeated_lines(make([(None, None)])).collect()[0][:3] == (None, 1, 0)
    no_text = linededup.remove_repeated_lines(make(rows), texts=False)
    assert no_text.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (8, 4), (20, 3)])
def test_batches_do_not_change_the_result(make, batches, fanout):
    rng = random.Random(batches)
    rows = [(rng.randint(-50, 90), "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 6)))) for _ in range(120)]
    assert found(make(rows), batches=batches, fanout=fanout) == brute(rows)


def test_order_of_batches_does_not_matter(make):
    rows = [(i, "\n".join(random.Random(i).choices(LINES, k=3))) for i in range(60)]
    docs = make(rows)
    wanted = {r[:2]: r[2] for r in map(tuple, _runs(docs, range(5)).repeated().collect())}
    again = _runs(docs, (3, 0, 4, 1, 2))
    assert {r[:2]: r[2] for r in map(tuple, again.repeated().collect())} == wanted
    assert len(wanted) > 5 and [len(level) for level in again.levels] == [1, 0, 1]


def _runs(docs, order):
    runs = linededup.LineRuns(docs.sparkSession, fanout=2)
    lines = linededup.line_hashes(docs, 20)
    for part in order:
        runs.add(lines.where(F.col("doc_id") % 5 == part))
    return runs


def test_runs_are_joined_where_they_lie(spark, make):
    runs = linededup.LineRuns(spark)
    lines = linededup.line_hashes(make([(i, LINES[0]) for i in range(9)]), 20)
    runs.add(lines)
    assert spark.catalog.listTables() == []
    runs.add(linededup.line_hashes(make([(-3, LINES[2])]), 20))
    a, b = (run.table for run in runs.runs)
    plan = b.hint("merge").join(a.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # what is settled already is not written again
    runs.add(linededup.line_hashes(make([(-1, LINES[0]), (-2, LINES[1])]), 20))
    assert [r.table.count() for r in runs.runs] == [1, 1, 1]


def test_a_line_of_most_documents_and_a_long_document(make):
    rows = [(i, f"{LINES[0]}\nown line of the document {i}") for i in range(3000)]
    rows.append((5000, "\n".join([LINES[0], "x" * 30] * 20_000)))
    rows.append((4000, "\n".join([LINES[0], f"y{'z' * 30}"] * 20_000)))
    assert found(make(rows)) == brute(rows)


def test_no_python_on_the_path(make):
    docs = make([(1, "a\nb")])
    for df in (linededup.remove_repeated_lines(docs), linededup.line_hashes(docs, 20)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
