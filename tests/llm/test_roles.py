import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import roles

GO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(letters):
    """Least (cost, audit) by the four places of the regular expression (s?(ua)+)?."""

    def with_inserts(best):
        best, work = dict(best), list(best)
        while work:
            place = work.pop()
            for role in "ua":
                after = GO.get((place, role))
                new = best[place][0] + 3, best[place][1] + "I"
                if after is not None and (after not in best or new < best[after]):
                    best[after] = new
                    work.append(after)
        return best

    best = {0: (0, "")}
    for letter in letters:
        after, extra = {}, 3 if letter.isupper() else 0
        for place, (cost, audit) in with_inserts(best).items():
            options = [(place, cost + 4, audit + "D")]
            if letter not in "bd":
                options += [(GO[place, letter.lower()], cost + extra, audit + "K")] if (place, letter.lower()) in GO else []
                options += [(GO[place, r], cost + extra + 3, audit + "R") for r in "ua" if (place, r) in GO]
            for there, *value in options:
                after[there] = min(after.get(there, (10**9, "")), tuple(value))
        best = after
    return min(v for place, v in with_inserts(best).items() if place in (0, 3))


def by_runs(repair, letters, sizes):
    front, start = {repair.first: (0, 0, None)}, 0
    for size in sizes:
        table = {}
        for origin, *move in repair.moves(letters[start : start + size], start > 0):
            table.setdefault(origin, []).append(tuple(move))
        front, start = repair.advance(front, table), start + size
    return repair.finish(front)


def test_all_short_conversations():
    repair = roles.Repair()
    for n in range(5):
        for letters in map("".join, itertools.product("bsuaoSUAO", repeat=n)):
            assert by_runs(repair, letters, [n]) == cheapest(letters), letters


@settings(max_examples=300, deadline=None)
@given(st.text("bdsuaoSUAO", max_size=60), st.lists(st.integers(1, 20), min_size=60, max_size=60))
def test_runs_chained_equal_the_whole(letters, sizes):
    repair = roles.repairer(roles.Costs())
    assert by_runs(repair, letters, sizes) == cheapest(letters)


def test_stacks_share_what_is_below():
    repair = roles.Repair()
    # no more stacks for long conversations than for short ones
    assert len(repair.live) == 8
    assert all(below is None or below < len(repair.stacks) for _, below in repair.stacks)


def brute(rows, ids):
    out = []
    for conv in {*ids}:
        mine = sorted(
            ((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv)
        )
        seen, letters = set(), ""
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            if not bare:
                letters += "b"
            elif (role, text) in seen:
                letters += "d"
            else:
                letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
                letters += letter if bare[-1] in ".!?" else letter.upper()
            seen.add((role, text))
        cost, audit = cheapest(letters)
        lines, place, i = [], 0, 0
        for edit in audit:
            if edit != "I":
                _, _, role, text = mine[i]
                i += 1
            if edit == "D":
                continue
            if edit == "K":
                place = GO[place, role[:1]]
            else:
                initial = next(r for r in "ua" if (place, r) in GO)
                place = GO[place, initial]
                role, text = {"u": "user", "a": "assistant"}[initial], "" if edit == "I" else text
            lines.append(f"{role}:{text}")
        turns = {t for known, t, *_ in mine if known}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        counts = [letters.count("b"), letters.count("d"), sum(map(str.isupper, letters)), sum(p not in ("su", "ua", "au") for p in pairs)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((str(conv), gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def found(df, ids):
    return sorted((str(r[0]), *r[1:]) for r in roles.repair_roles(df, ids).collect())


def test_edges(turns):
    rows = [
        (1, 0, "user", "hi."), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, None, "system", "s!"),
        (2, None, None, None), (2, 5, "tool", "x."), (2, 9, "", "."), (None, 1, "user", "q?"), (None, 2, "assistant", "a."),
        (3, 0, "user", " \n\t"), (4, 0, "system", "only."), (5, 0, "assistant", "é日。"), (5, 0, "assistant", "long " * 20_000),
        (6, 3, "user", "a\nb."), (6, 4, "User", "A."), (6, 5, "usher", "B."),
    ]
    ids = [r[0] for r in rows] + [7, 7]
    table = turns(rows).selectExpr("*", "1 AS at", "2 AS cost", "'x' AS `a.b`", "3 AS letter")
    assert found(table, turns([(i, None, None, None) for i in ids])) == brute(rows, ids)
    assert roles.repair_roles(turns([]), turns([])).count() == 0
    empty = roles.repair_roles(turns([]), turns([(9, 1, "user", "x")])).collect()
    assert [tuple(r) for r in empty] == brute([], [9]) or [(str(r[0]), *r[1:]) for r in empty] == brute([], [9])


def test_random_tables(turns):
    rng = random.Random(5)
    texts = ["yes.", "no!", "cut", "", " ", "why?"] + [f"t{i}." for i in range(9)]
    rows = [
        (rng.randint(0, 60), rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "tool", "ai"]), rng.choice(texts))
        for _ in range(600)
    ]
    assert found(turns(rows), turns(rows)) == brute(rows, [r[0] for r in rows])


def test_a_conversation_over_many_partitions(spark, turns):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _over_many_partitions(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _over_many_partitions(turns):
    rng = random.Random(6)
    rows = [(0, i // 2, rng.choice(["user", "assistant", "system"]), f"text {i}{rng.choice(['.', ''])}") for i in range(30_000)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", "a." + str(i) + "!") for c in range(1, 200) for i in range(4)]
    ordered = roles.ordered(turns(rows))
    parts = ordered.where("conv_id = 0").selectExpr("shiftright(at, 33) AS part").distinct().count()
    assert parts > 3
    assert found(turns(rows), turns(rows)) == brute(rows, range(200))


def test_repaired_rows_are_a_conversation(turns):
    rng = random.Random(7)
    rows = [(c, i, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b", "c!", ""])) for c in range(50) for i in range(rng.randint(0, 9))]
    table, verdicts = roles.examined(turns(rows))
    whole = {}
    for r in sorted(roles.repaired_turns(table, verdicts).collect(), key=lambda r: (r.conv_id, r.place)):
        whole.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in roles.repaired_digests(table, verdicts).collect()}
    for conv, lines in whole.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines))
        assert [r.place for r in lines] == list(range(len(lines)))
        assert digests[conv] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
