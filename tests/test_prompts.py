"""Prompt text, wide and long readings."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import prompts as P
from caseloom.operators import readings as L

DEMO = {
    "Cancer family history": "yes", "Breast operations": None, "r:AgeInYears": 45, "Cycle": "28-35",
    "Day from the first day": "3", "Num of pregnancies": None, "Hormonal medications": "no",
}


@pytest.fixture(scope="module")
def case(spark):
    names = ["case_id", "L0 sk", "R1 int", "R0 int", "L0 int", "R0 sk", *DEMO]
    schema = "case_id int, `L0 sk` double, `R1 int` double, `R0 int` double, `L0 int` double, `R0 sk` double, " + ", ".join(
        f"`{n}` {'int' if n == 'r:AgeInYears' else 'string'}" for n in DEMO
    )
    return spark.createDataFrame([(1, 33.5, None, 36.125, float("nan"), 34.0, *DEMO.values())], schema).select(*[f"`{n}`" for n in names])


TEMPS = "R0 int: 36.12; R0 sk: 34.00; R1 int: nan; L0 int: nan; L0 sk: 33.50"
MEDICAL = "Cancer history: yes; Breast ops: nan"
DEMOGRAPHIC = "Age: 45; Cycle: 28-35; Day: 3; Pregnancies: nan; Hormonal meds: no"


@pytest.mark.parametrize(
    "order, parts",
    [("right", (TEMPS, MEDICAL, DEMOGRAPHIC)), ("left", (DEMOGRAPHIC, MEDICAL, TEMPS)),
     ("middle", (MEDICAL, TEMPS, DEMOGRAPHIC)), ("anything", (MEDICAL, TEMPS, DEMOGRAPHIC))],
)
def test_orderings(case, order, parts):
    assert P.with_prompt(case, order).first().prompt == "MWR data: " + "; ".join(parts)


def test_audit_counts_what_is_cut(case):
    audit = {(r.ordering, r.part): (r.tokens, r.tokens_cut) for r in
             P.truncation_audit(case, P.case_parts(case.columns), 20).collect()}
    text = P.with_prompt(case, "left").first().prompt
    total = sum(tokens for (order, _), (tokens, _) in audit.items() if order == "left")
    assert total + 2 == len(text.split())
    assert sum(cut for (order, _), (_, cut) in audit.items() if order == "left") == len(text.split()) - 20
    assert audit["right", "temps"][1] == 0 and audit["left", "temps"][1] > 0


def test_long_form_and_asymmetry(case, rows):
    long = L.readings_long(case, ["case_id"]).where("temp is not null and not isnan(temp)")
    assert rows(long) == [(1, "L", 0, "sk", 33.5), (1, "R", 0, "int", 36.125), (1, "R", 0, "sk", 34.0)]
    wide = L.asymmetry(case, ["case_id"])
    assert wide.columns == ["case_id", "diff0_int", "diff0_sk"]
    assert wide.first().diff0_sk == 0.5


def test_slices(spark):
    df = spark.range(100).withColumn("k", 100 - F.col("id"))
    assert [r.id for r in L.take_slice(df, "id", 10, 5).collect()] == [10, 11, 12, 13, 14]
    assert sorted(r.id for r in L.take_slice(df, "k", 0, 2).collect()) == [98, 99]
