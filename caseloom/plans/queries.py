"""Registered queries: each operator over the driver's tables, with its SQL twin.

Where a query has SQL, both give the same columns, types and (rounded) values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import columns as C
from caseloom.operators import classes, importance, learning, median, moments, prompts, readings, regression, runs, search
from caseloom.operators import sequences, splitting, subwords, texts, trials
from caseloom.plans import tables
from caseloom.plans.evaluation import evaluate, evaluate_while_writing
from caseloom.plans.preparation import prepare_cases
from caseloom.session import new_folder, stored
from caseloom.sources import batches
from caseloom.sources import cases as case_source
from caseloom.sources import runs as run_source
from caseloom.sources.versions import KeyedAppends, current

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def _rounded(digits: int, **columns) -> list:
    """Rounded columns without negative zero."""
    return [(F.round(c, digits) + F.lit(0.0)).alias(name) for name, c in columns.items()]


# --- shapes shared by the SQL texts ----------------------------------------

HISTORY = """history AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         event_type AS kind, value
  FROM events)"""
BATCHES = HISTORY + """, batches AS (
  SELECT run_id, (epoch - 1) // 8 AS epoch, (epoch - 1) % 8 AS batch,
         CASE WHEN epoch % 13 <> 0 THEN value END AS loss, (epoch - 1) % 5 + 1 AS n_rows
  FROM history)"""
CHECKS = HISTORY + """, checks AS (
  SELECT run_id, epoch, value AS val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS chk
  FROM history WHERE epoch % 5 <> 0)"""
PAIRS = r"""pairs AS (
  SELECT a.conv_id || '-' || a.turn AS row_id,
         CASE WHEN a.conv_id % 7 = 0 THEN ' ' || chr(10) || ' ' ELSE a.text END AS prediction,
         b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user')"""
CASES = """cases AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 100 END AS r0i, c_acctbal / 300 AS r0s,
         c_acctbal / 150 - 3 AS r1i,
         CASE WHEN c_custkey % 5 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal / 80 END AS l0i, c_acctbal / 160 AS l0s,
         c_nationkey / 8 AS l1i, c_mktsegment AS history,
         CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS operations, c_nationkey + 30 AS age,
         CASE c_custkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '-1'
              WHEN 2 THEN (c_nationkey + 20) || '-' || (c_nationkey + 27)
              WHEN 3 THEN 'unknown' WHEN 4 THEN (c_nationkey + 20)::VARCHAR END AS cycle,
         (c_custkey % 28)::VARCHAR AS day,
         CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 3)::VARCHAR END AS pregnancies, c_name AS hormones
  FROM customer)"""
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
VOCAB = """words AS (
  SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, """ + WORDS.format("text") + """ AS ws FROM documents)),
vocab AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 2 AS token_id
  FROM (SELECT token, count(*) AS n FROM words GROUP BY token))"""
CLASSES = """pairs AS (
  SELECT l.doc_id, l.quality AS y, l.toxic AS p, d.n_chars::DOUBLE AS score
  FROM labels l JOIN documents d USING (doc_id))"""


# --- labels, values and prompts --------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS label
FROM lineitem""")
def zero_label(spark, folder):
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", C.zero_label("l_discount").alias("label")
    )


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE lang END AS lang
FROM documents""")
def na_tokens(spark, folder):
    form = F.col("doc_id") % 7
    injected = F.when(form == 0, "n/a").when(form == 1, "NaN").when(form == 2, "").otherwise(F.col("lang"))
    return tables.table(spark, folder, "documents").select("doc_id", C.na_to_null(injected).alias("lang"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS target FROM documents")
def target_text(spark, folder):
    text = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return tables.table(spark, folder, "documents").select("doc_id", C.target_text(text).alias("target"))


# order of the parts, written out once more for the SQL
ORDERS = {
    "right": ("temps", "medical", "demographic"),
    "left": ("demographic", "medical", "temps"),
    "middle": ("medical", "temps", "demographic"),
}


def _prompt_sql(order: str) -> str:
    def reading(label: str, c: str) -> str:
        return f"'{label}: ' || CASE WHEN {c} IS NULL OR isnan({c}) THEN 'nan' ELSE printf('%.2f', {c}) END"

    def text(label: str, c: str) -> str:
        return f"'{label}: ' || coalesce({c}::VARCHAR, 'nan')"

    groups = {
        "temps": [reading(*p) for p in (
            ("R0 int", "r0i"), ("R0 sk", "r0s"), ("R1 int", "r1i"), ("L0 int", "l0i"), ("L0 sk", "l0s"),
            ("L1 int", "l1i"))],
        "medical": [text("Cancer history", "history"), text("Breast ops", "operations")],
        "demographic": [text(*p) for p in (
            ("Age", "age"), ("Cycle", "cycle"), ("Day", "day"), ("Pregnancies", "pregnancies"),
            ("Hormonal meds", "hormones"))],
    }
    parts = " || '; ' || ".join(f"({p})" for g in ORDERS[order] for p in groups[g])
    return f"WITH {CASES} SELECT c_custkey, 'MWR data: ' || {parts} AS prompt FROM cases"


def _prompt(spark, folder, order):
    return prompts.with_prompt(tables.cases(spark, folder), order).select("c_custkey", "prompt")


@query(_prompt_sql("right"))
def prompt_right(spark, folder):
    return _prompt(spark, folder, "right")


@query(_prompt_sql("left"))
def prompt_left(spark, folder):
    return _prompt(spark, folder, "left")


@query(_prompt_sql("middle"))
def prompt_middle(spark, folder):
    return _prompt(spark, folder, "middle")


@query("""SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS quarter,
round_even(l_extendedprice / 8, 1) AS eighth FROM lineitem""")
def round_half_even(spark, folder):
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.round_half_even(F.col("l_quantity") / 4).alias("quarter"),
        C.round_half_even(F.col("l_extendedprice") / 8).alias("eighth"),
    )


@query(f"""WITH {CASES} SELECT c_custkey, CASE WHEN cycle IS NULL OR cycle IN ('n/a', '-1') THEN 'absent'
WHEN contains(cycle, '-') THEN 'irregular' WHEN cycle = 'unknown' THEN 'other' ELSE 'regular' END AS status
FROM cases""")
def cycle_status(spark, folder):
    return tables.cases(spark, folder).select("c_custkey", C.cycle_status("Cycle").alias("status"))


@query("""SELECT * FROM (SELECT 'first' AS part, c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'next', c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10)""")
def slice_rows(spark, folder):
    rows = tables.table(spark, folder, "customer").select("c_custkey", "c_name")
    first = readings.take_slice(rows, "c_custkey", 0, 10).select(F.lit("first").alias("part"), "*")
    return first.unionByName(readings.take_slice(rows, "c_custkey", 10, 5).select(F.lit("next").alias("part"), "*"))


@query(f"""WITH {CASES}, long AS (SELECT c_custkey,
  unnest(['R0 int', 'R0 sk', 'R1 int', 'L0 int', 'L0 sk', 'L1 int']) AS reading,
  unnest([r0i, r0s, r1i, l0i, l0s, l1i]) AS temp FROM cases)
SELECT c_custkey, reading[1] AS side, reading[2]::INTEGER AS pos, split_part(reading, ' ', 2) AS kind,
  CASE WHEN NOT isnan(temp) THEN round(temp, 9) END AS temp FROM long""")
def readings_long(spark, folder):
    long = readings.readings_long(tables.cases(spark, folder), ["c_custkey"])
    return long.select("c_custkey", "side", "pos", "kind", F.round(C.nan_to_null("temp"), 9).alias("temp"))


@query(f"""WITH {CASES} SELECT c_custkey, CASE WHEN NOT isnan(l0i) THEN round(abs(r0i - l0i), 9) END AS diff0_int,
round(abs(r0s - l0s), 9) AS diff0_sk, round(abs(r1i - l1i), 9) AS diff1_int FROM cases""")
def asymmetry(spark, folder):
    wide = readings.asymmetry(tables.cases(spark, folder), ["c_custkey"])
    return wide.select(
        "c_custkey", *[F.round(C.nan_to_null(c), 9).alias(c) for c in ("diff0_int", "diff0_sk", "diff1_int")]
    )


# --- regression -------------------------------------------------------------

FIT_TARGETS = ("l_extendedprice", "l_discount", "l_tax")
LINE_KEYS = ("l_orderkey", "l_linenumber")


def _lineitem(spark, folder, *names):
    return tables.table(spark, folder, "lineitem").select(*LINE_KEYS, *names)


@query("""WITH long AS (
  SELECT l_returnflag, l_quantity AS x, unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS target,
         unnest([l_extendedprice, l_discount, l_tax]) AS y FROM lineitem)
SELECT l_returnflag, target, round(regr_slope(y, x), 6) + 0.0::DOUBLE AS slope,
  round(regr_intercept(y, x), 4) + 0.0::DOUBLE AS intercept, round(avg(x), 6) AS control_mean,
  regr_count(y, x)::BIGINT AS pairs, (count(*) - regr_count(y, x))::BIGINT AS dropped
FROM long GROUP BY l_returnflag, target""")
def ols_fit(spark, folder):
    rows = _lineitem(spark, folder, "l_returnflag", "l_quantity", *FIT_TARGETS)
    return regression.fit_lines(rows, FIT_TARGETS, "l_quantity", ["l_returnflag"]).select(
        "l_returnflag",
        "target",
        *_rounded(6, slope=F.col("slope")),
        *_rounded(4, intercept=F.col("intercept")),
        F.round("control_mean", 6).alias("control_mean"),
        "pairs",
        "dropped",
    )


@query(SQL["ols_fit"])
def merged_fit(spark, folder):
    """The same lines out of the stored moments of each line status, as if each were a file of its own."""
    rows = _lineitem(spark, folder, "l_returnflag", "l_linestatus", "l_quantity", *FIT_TARGETS)
    parts = stored(moments.line_moments(rows, FIT_TARGETS, "l_quantity", ["l_returnflag", "l_linestatus"]), "moments")
    whole = moments.merged_moments(parts, ["l_returnflag"])
    return moments.lines_from_moments(whole, ["l_returnflag"]).select(
        "l_returnflag",
        "target",
        *_rounded(6, slope=F.col("slope")),
        *_rounded(4, intercept=F.col("intercept")),
        F.round("control_mean", 6).alias("control_mean"),
        "pairs",
        "dropped",
    )


def _clean(df, *names):
    """Without negative zero."""
    return df.withColumns({n: F.col(n) + F.lit(0.0) for n in names})


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k1, regr_intercept(l_extendedprice, l_quantity) AS b1,
  regr_slope(l_discount, l_quantity) AS k2, regr_intercept(l_discount, l_quantity) AS b2,
  regr_slope(l_tax, l_quantity) AS k3, regr_intercept(l_tax, l_quantity) AS b3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity,
  round_even(l_extendedprice - (k1 * l_quantity + b1), 1) + 0.0::DOUBLE AS l_extendedprice,
  round_even(l_discount - (k2 * l_quantity + b2), 1) + 0.0::DOUBLE AS l_discount,
  round_even(l_tax - (k3 * l_quantity + b3), 1) + 0.0::DOUBLE AS l_tax FROM lineitem, f""")
def residual_one(spark, folder):
    rows = _lineitem(spark, folder, "l_quantity", *FIT_TARGETS)
    return _clean(regression.residual(rows, FIT_TARGETS, "l_quantity"), *FIT_TARGETS)


RESIDUAL_TWO = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k, regr_intercept(l_extendedprice, l_quantity) AS b
  FROM lineitem),
one AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount,
  round_even(l_extendedprice - (k * l_quantity + b), 1) AS y FROM lineitem, f),
g AS (SELECT regr_slope(y, l_tax) AS k, regr_intercept(y, l_tax) AS b FROM one)
SELECT l_orderkey, l_linenumber, l_quantity, l_tax, CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS label,
  round_even(y - (k * l_tax + b), 1) + 0.0::DOUBLE AS l_extendedprice FROM one, g"""


@query(RESIDUAL_TWO)
def residual_two(spark, folder):
    rows = _lineitem(
        spark, folder, "l_quantity", "l_tax", C.zero_label("l_discount").alias("label"), "l_extendedprice"
    )
    done = regression.staged_residual(rows, ["l_extendedprice"], ["l_quantity", "l_tax"])
    return _clean(done, "l_extendedprice")


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k, avg(l_quantity) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice + k * (m - l_quantity), 4) AS l_extendedprice
FROM lineitem, f""")
def mean_shift(spark, folder):
    rows = _lineitem(spark, folder, "l_quantity", "l_extendedprice")
    done = regression.mean_shift(rows, ["l_extendedprice"], "l_quantity")
    return done.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS k,
  regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
  round_even(l_extendedprice - (k * l_quantity + b), 1) + 0.0::DOUBLE AS l_extendedprice
FROM lineitem JOIN f USING (l_returnflag)""")
def residual_grouped(spark, folder):
    rows = _lineitem(spark, folder, "l_returnflag", "l_quantity", "l_extendedprice")
    done = regression.residual(rows, ["l_extendedprice"], "l_quantity", ["l_returnflag"])
    return _clean(done, "l_extendedprice")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS internal,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS a, l_extendedprice / 1300 + l_discount AS b FROM lineitem),
f AS (SELECT regr_slope(a, x) AS ka, regr_intercept(a, x) AS ba, regr_slope(b, x) AS kb, regr_intercept(b, x) AS bb FROM r)
SELECT l_orderkey, l_linenumber, internal AS "L0 int", round_even(a - (ka * x + ba), 1) + 0.0::DOUBLE AS "L0 sk",
round_even(b - (kb * x + bb), 1) + 0.0::DOUBLE AS "R3 sk" FROM r, f""")
def normalise_skin(spark, folder):
    """Skin readings on the skin control; internal readings stay as they are."""
    price = F.col("l_extendedprice")
    rows = _lineitem(
        spark, folder, price.alias("L0 int"), F.when(F.col("l_returnflag") != "R", price / 1000).alias("L0 sk"),
        (price / 1300 + F.col("l_discount")).alias("R3 sk"), F.col("l_quantity").alias("T1 sk"),
    )
    done = regression.normalise_readings(rows, kinds=("sk",), controls=("T1 sk",))
    return _clean(done.drop("T1 sk"), "L0 sk", "R3 sk")


WIDE = [f"{side}{pos} int" for side in "LR" for pos in range(10)]


def _wide_sql() -> str:
    """Both stages of all columns: a fit and a residual on each control."""
    raw = ", ".join(
        f"""CASE WHEN l_returnflag <> 'R' OR {i % 4} <> 0 THEN l_extendedprice / {997 + 13 * i} + l_discount * {i} END AS "{n}\""""
        for i, n in enumerate(WIDE)
    )

    def stage(out: str, source: str, control: str) -> str:
        fits = ", ".join(f'regr_slope("{n}", {control}) AS k{i}, regr_intercept("{n}", {control}) AS b{i}' for i, n in enumerate(WIDE))
        new = ", ".join(f'round_even("{n}" - (k{i} * {control} + b{i}), 1) + 0.0::DOUBLE AS "{n}"' for i, n in enumerate(WIDE))
        return f"""{out}_fit AS (SELECT {fits} FROM {source}),
{out} AS (SELECT l_orderkey, l_linenumber, x1, x2, cancer_risk, {new} FROM {source}, {out}_fit)"""

    columns = ", ".join(f'"{n}"' for n in WIDE)
    return f"""WITH wide AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_tax * 100 AS x2,
  CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS cancer_risk, {raw} FROM lineitem),
{stage("one", "wide", "x1")}, {stage("two", "one", "x2")}
SELECT l_orderkey, l_linenumber, cancer_risk, {columns} FROM two"""


@query(_wide_sql())
def normalise_cases(spark, folder):
    done = regression.label_and_normalise(tables.wide_cases(spark, folder))
    return _clean(done.select(*LINE_KEYS, "cancer_risk", *WIDE), *WIDE)


def _counts_sql() -> str:
    used = ", ".join(f"count(*) FILTER (l_returnflag <> 'R' OR {i % 4} <> 0)" for i in range(len(WIDE)))
    return f"""WITH sums AS (SELECT count(*) AS n, [{used}] AS used FROM lineitem),
targets AS (SELECT n, unnest({WIDE}) AS target, unnest(used) AS pairs FROM sums)
SELECT control, target, pairs::BIGINT AS pairs, (n - pairs)::BIGINT AS dropped
FROM targets, (SELECT unnest(['T1 int', 'T1 sk']) AS control)"""


@query(_counts_sql())
def dropped_pairs(spark, folder):
    """Pairs that the fits of both stages used and left out."""
    return regression.staged_residual_counted(tables.wide_cases(spark, folder), WIDE, ("T1 int", "T1 sk"))[1]


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS k, regr_intercept(l_extendedprice, l_quantity) AS b
  FROM lineitem WHERE l_orderkey % 10 < 7)
SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_extendedprice - (k * l_quantity + b), 1) + 0.0::DOUBLE AS l_extendedprice
FROM lineitem, f""")
def fit_apply(spark, folder):
    """Coefficients of the training rows, applied to all rows."""
    rows = _lineitem(spark, folder, "l_quantity", "l_extendedprice")
    fits = regression.fit_lines(rows.where(F.col("l_orderkey") % 10 < 7), ["l_extendedprice"], "l_quantity")
    return _clean(regression.residual(rows, ["l_extendedprice"], "l_quantity", fits=fits), "l_extendedprice")


# --- classes and losses -----------------------------------------------------

LOGITS = """logits AS (SELECT c_custkey, c_acctbal / 1000 AS z0, c_nationkey / 10 AS z1, c_nationkey % 2 AS y
  FROM customer)"""


@query(f"""WITH {LOGITS} SELECT c_custkey, round(greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1))
  + exp(z1 - greatest(z0, z1))) - CASE WHEN y = 1 THEN z1 ELSE z0 END, 6) AS loss FROM logits""")
def cross_entropy(spark, folder):
    return tables.logits(spark, folder).select("c_custkey", F.round(C.cross_entropy("z0", "z1", "y"), 6).alias("loss"))


@query("""SELECT event_id, round(CASE WHEN event_id % 7 <> 0 THEN value END * 0.5 + value / 3 * 0.5, 6) AS loss
FROM events""")
def weighted_loss(spark, folder):
    gen = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    loss = C.weighted_loss(gen, F.col("value") / 3)
    return tables.table(spark, folder, "events").select("event_id", F.round(loss, 6).alias("loss"))


@query(f"""WITH {LOGITS} SELECT c_custkey, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS decision,
round(1 / (1 + exp(z0 - z1)), 6) AS probability FROM logits""")
def class_decision(spark, folder):
    return tables.logits(spark, folder).select(
        "c_custkey",
        C.class_decision("z0", "z1").alias("decision"),
        F.round(C.positive_probability("z0", "z1"), 6).alias("probability"),
    )


@query("""SELECT vec_id,
round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * ((i - 1) % 5 - 2) / 10)) + 0.1::DOUBLE, 6) AS z0,
round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * ((i - 1) % 3 - 1) / 4)) - 0.2::DOUBLE, 6) AS z1
FROM embeddings""")
def linear_head(spark, folder):
    heads = {"z0": ([(i % 5 - 2) / 10 for i in range(64)], 0.1), "z1": ([(i % 3 - 1) / 4 for i in range(64)], -0.2)}
    return tables.table(spark, folder, "embeddings").select(
        "vec_id", *[F.round(C.linear_score("embedding", w, b), 6).alias(n) for n, (w, b) in heads.items()]
    )


@query(f"""WITH {CLASSES} SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM pairs""")
def confusion(spark, folder):
    return classes.confusion(tables.class_pairs(spark, folder), "y", "p")


CLASS_METRICS = """class_counts AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
  count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM pairs),
metrics AS (SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM class_counts)"""


@query(f"WITH {CLASSES}, {CLASS_METRICS} SELECT * FROM metrics")
def class_metrics(spark, folder):
    found = classes.class_metrics(tables.class_pairs(spark, folder), "y", "p")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


AUC = """auc AS (SELECT round((sum(CASE WHEN y = 1 THEN r END) - any_value(p) * (any_value(p) + 1) / 2)
  / (any_value(p) * any_value(n)), 6) AS roc_auc
  FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r,
    count(*) FILTER (y = 1) OVER () AS p, count(*) FILTER (y = 0) OVER () AS n FROM pairs))"""


@query(f"WITH {CLASSES}, {AUC} SELECT * FROM auc")
def roc_auc(spark, folder):
    return classes.roc_auc(tables.class_pairs(spark, folder), "y", "score").select(
        F.round("roc_auc", 6).alias("roc_auc")
    )


# --- text pairs -------------------------------------------------------------

@query(f"WITH {PAIRS} SELECT * FROM pairs")
def align_pairs(spark, folder):
    pairs = tables.text_pairs(spark, folder)
    return texts.align_pairs(pairs.drop("reference"), pairs.drop("prediction")).select(
        "row_id", "prediction", "reference"
    )


@query(rf"""WITH {PAIRS} SELECT row_id, regexp_replace(prediction, '^\s+|\s+$', '', 'g') AS prediction,
regexp_replace(reference, '^\s+|\s+$', '', 'g') AS reference FROM pairs
WHERE regexp_matches(prediction, '\S') AND regexp_matches(reference, '\S')""")
def nonblank_pairs(spark, folder):
    return texts.nonblank_pairs(tables.text_pairs(spark, folder))


@query(rf"""WITH {PAIRS}, bad AS (SELECT * FROM pairs
WHERE NOT (regexp_matches(prediction, '\S') AND regexp_matches(reference, '\S')))
SELECT bad.*, c.text AS input, greatest((SELECT count(*) FROM bad) - 5, 0)::BIGINT AS more
FROM bad LEFT JOIN conversations c ON c.conv_id || '-' || c.turn = row_id ORDER BY row_id LIMIT 5""")
def rejected_pairs(spark, folder):
    said = tables.table(spark, folder, "conversations")
    inputs = said.select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), F.col("text").alias("input"))
    return texts.rejected_pairs(tables.text_pairs(spark, folder), inputs=inputs)


@query(rf"""WITH {PAIRS} SELECT count(*) FILTER (NOT (regexp_matches(prediction, '\S')
AND regexp_matches(reference, '\S'))) AS rejected, count(*) AS pairs FROM pairs""")
def rejected_count(spark, folder):
    return texts.rejected_count(tables.text_pairs(spark, folder))


def _meteor_sql(source: str) -> str:
    def side(c: str) -> str:
        return f"""SELECT row_id, w AS word, p, row_number() OVER (PARTITION BY row_id, w ORDER BY p DESC) AS nth
  FROM (SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
        FROM (SELECT row_id, {WORDS.format(f"lower({c})")} AS ws FROM {source}))"""

    return f"""h AS ({side("prediction")}), r AS ({side("reference")}),
met AS (SELECT row_id, h.p AS hp, r.p AS rp FROM h JOIN r USING (row_id, word, nth)),
runs AS (SELECT row_id, CASE WHEN hp = lag(hp) OVER w + 1 AND rp = lag(rp) OVER w + 1 THEN 0 ELSE 1 END AS starts
  FROM met WINDOW w AS (PARTITION BY row_id ORDER BY hp)),
counts AS (SELECT row_id, count(m.row_id) AS matches, coalesce(sum(starts), 0) AS chunks, any_value(hw) AS hw,
  any_value(rw) AS rw
  FROM (SELECT row_id, len({WORDS.format("lower(prediction)")}) AS hw, len({WORDS.format("lower(reference)")}) AS rw
        FROM {source}) s LEFT JOIN (SELECT row_id, starts FROM runs) m USING (row_id) GROUP BY row_id),
scores AS (SELECT row_id, matches::BIGINT AS matches, chunks::BIGINT AS chunks, hw::BIGINT AS hyp_words,
  rw::BIGINT AS ref_words, CASE WHEN matches = 0 THEN 0::DOUBLE ELSE
  (matches / hw) * (matches / rw) / (0.9::DOUBLE * (matches / hw) + 0.1::DOUBLE * (matches / rw))
  * (1 - 0.5::DOUBLE * pow(chunks / matches, 3)) END AS meteor FROM counts)"""


@query(f"""WITH {PAIRS}, {_meteor_sql("pairs")}
SELECT row_id, matches, chunks, hyp_words, ref_words, round(meteor, 6) AS meteor FROM scores""")
def meteor(spark, folder):
    scores = texts.meteor(tables.text_pairs(spark, folder))
    return scores.withColumn("meteor", F.round("meteor", 6))


EMBEDDING_MATCH = """vectors AS (SELECT vec_id // 16 AS row_id, vec_id % 16 < 8 AS hyp, vec_id, embedding::DOUBLE[] AS v
  FROM embeddings),
cosines AS (SELECT a.row_id, a.vec_id AS h, b.vec_id AS r, list_cosine_similarity(a.v, b.v) AS cosine
  FROM vectors a JOIN vectors b ON a.row_id = b.row_id WHERE a.hyp AND NOT b.hyp),
best_hyp AS (SELECT row_id, avg(best) AS p FROM (SELECT row_id, max(cosine) AS best FROM cosines GROUP BY row_id, h)
  GROUP BY row_id),
best_ref AS (SELECT row_id, avg(best) AS r FROM (SELECT row_id, max(cosine) AS best FROM cosines GROUP BY row_id, r)
  GROUP BY row_id),
match AS (SELECT row_id, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall, coalesce(2 * p * r / (p + r), 0) AS f1
  FROM (SELECT DISTINCT row_id FROM vectors) LEFT JOIN best_hyp USING (row_id) LEFT JOIN best_ref USING (row_id))"""


@query(f"""WITH {EMBEDDING_MATCH} SELECT row_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(f1, 6) AS f1 FROM match""")
def embedding_match(spark, folder):
    scores = texts.embedding_match(tables.token_vectors(spark, folder))
    return scores.select("row_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT label, (p - 1)::INTEGER AS pos, round(avg(v), 6) + 0.0::DOUBLE AS mean
FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)
GROUP BY label, p""")
def mean_pool(spark, folder):
    pooled = texts.mean_pool(tables.table(spark, folder, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("mean").alias("pos", "m")).select(
        "label", "pos", *_rounded(6, mean=F.col("m"))
    )


@query(f"""WITH {EMBEDDING_MATCH}, asked AS (SELECT unnest([0, 1]) AS part)
SELECT part, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM asked LEFT JOIN match ON part = 0 GROUP BY part""")
def match_means(spark, folder):
    """Mean scores of all pairs, and of no pair, which are null."""
    scores = stored(texts.embedding_match(tables.token_vectors(spark, folder)), "scores")
    names = ("precision", "recall", "f1")
    means = [
        texts.mean_scores(scores.where(kept), *names).select(F.lit(part).alias("part"), *[F.round(c, 6).alias(c) for c in names])
        for part, kept in enumerate(("true", "f1 IS NULL"))
    ]
    return means[0].union(means[1])


@query(rf"""WITH {PAIRS}, good AS (SELECT * FROM pairs
  WHERE regexp_matches(prediction, '\S') AND regexp_matches(reference, '\S')),
{_meteor_sql("good")}, {CLASSES.replace("pairs AS", "labelled AS")},
{CLASS_METRICS.replace("FROM pairs", "FROM labelled")}, {AUC.replace("FROM pairs", "FROM labelled")},
{BATCHES}, {EMBEDDING_MATCH}
SELECT 'loss' AS metric, round(sum(coalesce(loss, 0)) / count(*), 6) AS value FROM batches
UNION ALL SELECT 'accuracy', accuracy FROM metrics UNION ALL SELECT 'f1', f1 FROM metrics
UNION ALL SELECT 'sensitivity', sensitivity FROM metrics UNION ALL SELECT 'specificity', specificity FROM metrics
UNION ALL SELECT 'roc_auc', roc_auc FROM auc UNION ALL SELECT 'meteor', round(avg(meteor), 6) FROM scores
UNION ALL SELECT 'rejected', (SELECT count(*) FROM pairs)::DOUBLE - (SELECT count(*) FROM good)
UNION ALL SELECT 'pairs', count(*)::DOUBLE FROM pairs
UNION ALL SELECT 'match_precision', round(avg(precision), 6) FROM match
UNION ALL SELECT 'match_recall', round(avg(recall), 6) FROM match
UNION ALL SELECT 'match_f1', round(avg(f1), 6) FROM match""")
def evaluate_summary(spark, folder):
    summary = evaluate(
        batches=tables.batch_log(spark, folder),
        classes=tables.class_pairs(spark, folder),
        pairs=tables.text_pairs(spark, folder),
        token_scores=texts.embedding_match(tables.token_vectors(spark, folder)),
    )
    return summary.select("metric", F.round("value", 6).alias("value"))


# --- words and sequences ----------------------------------------------------

@query(f"WITH {VOCAB} SELECT doc_id, token, count(*) AS n FROM words GROUP BY doc_id, token")
def tokens(spark, folder):
    return sequences.token_counts(tables.documents(spark, folder), ["doc_id"], "text")


@query(f"WITH {VOCAB} SELECT token, n, token_id FROM vocab")
def vocab(spark, folder):
    return sequences.vocabulary(tables.documents(spark, folder), "text")


def _encoded(spark, folder, limit=None):
    documents = tables.documents(spark, folder)
    words = sequences.vocabulary(documents, "text")
    return sequences.encode(sequences.token_rows(documents, ["doc_id"], {"text": "text"}, limit), words), words


@query(f"WITH {VOCAB} SELECT doc_id, pos::INTEGER AS pos, token_id FROM words JOIN vocab USING (token)")
def encode(spark, folder):
    encoded, _ = _encoded(spark, folder)
    return encoded.where(F.col("token").isNotNull()).select("doc_id", "pos", "token_id")


MAX_LEN = 512


@query(f"""WITH {VOCAB}, kept AS (SELECT doc_id, pos, token_id FROM words JOIN vocab USING (token)
  WHERE pos < {MAX_LEN - 1} UNION ALL
  SELECT doc_id, least(count(*), {MAX_LEN - 1}), 1 FROM words GROUP BY doc_id)
SELECT doc_id, count(*)::INTEGER AS n_kept, {MAX_LEN} - count(*)::INTEGER AS n_pad, count(*)::INTEGER AS mask_sum,
sum(token_id * (pos + 1))::BIGINT AS checksum FROM kept GROUP BY doc_id""")
def pad_mask(spark, folder):
    encoded, _ = _encoded(spark, folder, limit=MAX_LEN - 1)
    arrays = sequences.id_arrays(encoded, ["doc_id"], ["text"])
    ids, mask = sequences.fixed_length("text", MAX_LEN)
    fixed = arrays.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))
    add = lambda a, b: a + b
    weighted = F.transform("input_ids", lambda x, i: x.cast("bigint") * (i + 1))
    return fixed.select(
        "doc_id",
        F.size(F.filter("input_ids", lambda x: x != sequences.PAD_ID)).alias("n_kept"),
        F.size(F.filter("input_ids", lambda x: x == sequences.PAD_ID)).alias("n_pad"),
        F.aggregate("attention_mask", F.lit(0), add).alias("mask_sum"),
        F.aggregate(weighted, F.lit(0).cast("bigint"), add).alias("checksum"),
    )


def _example_sql() -> str:
    def side(name: str, text: str) -> str:
        return f"""{name}_words AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, {WORDS.format(text)} AS ws FROM documents)),
{name} AS (SELECT doc_id, count(*) AS n, sum(id * (pos + 1))::BIGINT AS checksum FROM (
  SELECT doc_id, pos, coalesce(token_id, 2) AS id FROM {name}_words LEFT JOIN vocab USING (token) WHERE pos < {MAX_LEN - 1}
  UNION ALL SELECT doc_id, (SELECT least(count(*), {MAX_LEN - 1}) FROM {name}_words w WHERE w.doc_id = d.doc_id), 1
  FROM documents d) GROUP BY doc_id)"""

    return f"""WITH {VOCAB}, {side("prompts", "text")}, {side("targets", "source || ' ' || lang")}
SELECT doc_id, p.n::INTEGER AS prompt_ids, p.checksum AS prompt_checksum, t.n::INTEGER AS target_ids,
t.checksum AS target_checksum, (doc_id % 2)::INTEGER AS class_labels FROM prompts p JOIN targets t USING (doc_id)"""


def _checksum(ids: str):
    weighted = F.transform(ids, lambda x, i: x.cast("bigint") * (i + 1))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, b: a + b)


@query(_example_sql())
def model_examples(spark, folder):
    documents = tables.documents(spark, folder).withColumn("cancer_risk", F.col("doc_id") % 2)
    words = sequences.vocabulary(documents, "text")
    target = F.concat_ws(" ", "source", "lang")
    made = sequences.examples(documents, words, ["doc_id"], "text", target, MAX_LEN)
    kept = lambda c: F.size(F.filter(c, lambda x: x != sequences.PAD_ID))
    return made.select(
        "doc_id",
        F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("prompt_ids"),
        _checksum("input_ids").alias("prompt_checksum"),
        kept("labels").alias("target_ids"),
        _checksum("labels").alias("target_checksum"),
        "class_labels",
    )


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS text FROM documents")
def decode(spark, folder):
    encoded, words = _encoded(spark, folder)
    arrays = sequences.id_arrays(encoded, ["doc_id"], ["text"])
    return sequences.decode(arrays.withColumnRenamed("text", "ids"), words, ["doc_id"], "ids")


def _audit_sql() -> str:
    sizes = {"temps": WORDS.format("text"), "medical": WORDS.format("lang"), "demographic": WORDS.format("source")}
    rows = []
    for name, order in ORDERS.items():
        start = "2"
        for group in order:
            rows.append(f"SELECT '{name}' AS ordering, '{group}' AS part, {group} AS n, {start} AS s FROM sizes")
            start += f" + {group}"
    return f"""WITH sizes AS (SELECT {", ".join(f"len({w}) AS {g}" for g, w in sizes.items())} FROM documents),
parts AS ({" UNION ALL ".join(rows)}),
cuts AS (SELECT ordering, part, n, n - greatest(least(s + n, {MAX_LEN}) - s, 0) AS cut FROM parts)
SELECT ordering, part, sum(n)::BIGINT AS tokens, sum(cut)::BIGINT AS tokens_cut, count(*) FILTER (cut > 0) AS rows_cut
FROM cuts GROUP BY ordering, part"""


@query(_audit_sql())
def truncation_audit(spark, folder):
    groups = {"temps": [F.col("text")], "medical": [F.col("lang")], "demographic": [F.col("source")]}
    return prompts.truncation_audit(tables.documents(spark, folder), groups, MAX_LEN)


# --- splits and batches -----------------------------------------------------

def _ranked_orders(seed: str) -> str:
    return f"""ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':{seed}'), o_orderkey) AS r,
  count(*) OVER () AS n FROM orders)"""


SPLIT = _ranked_orders("42") + """, sized AS (SELECT *, floor(0.7::DOUBLE * n)::BIGINT AS n_train FROM ranked),
split AS (SELECT o_orderkey, CASE WHEN r <= n_train THEN 'train'
  WHEN r <= n_train + floor((n - n_train) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)"""


def _orders(spark, folder):
    return tables.table(spark, folder, "orders").select("o_orderkey")


@query(f"WITH {SPLIT} SELECT o_orderkey, split FROM split")
def split_exact(spark, folder):
    return splitting.exact_split(_orders(spark, folder), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey, ('0x' || md5(o_orderkey || ':42')[1:8])::BIGINT / 4294967296 AS u FROM orders)""")
def split_hash(spark, folder):
    return splitting.hash_split(_orders(spark, folder), "o_orderkey")


@query(f"""WITH {SPLIT} SELECT split, count(*) AS rows, ceil(count(*) / 16)::BIGINT AS batches,
ceil(ceil(count(*) / 16) / 4)::BIGINT AS steps FROM split GROUP BY split""")
def split_summary(spark, folder):
    return splitting.batch_counts(splitting.exact_split(_orders(spark, folder), "o_orderkey"), by="split")


@query(f"WITH {_ranked_orders('42:0')} SELECT o_orderkey, (r - 1) // 16 AS batch_id FROM ranked")
def batch_shuffled(spark, folder):
    return splitting.shuffled_batches(_orders(spark, folder), "o_orderkey").select("o_orderkey", "batch_id")


@query(f"WITH {_ranked_orders('42:0')} SELECT o_orderkey, (r - 1) // 16 AS batch_id FROM ranked WHERE (r - 1) // 16 = 37")
def one_batch(spark, folder):
    """One shuffled batch, read out of files in batch order."""
    path = new_folder(spark, "batches")
    batches.write_batches(splitting.shuffled_batches(_orders(spark, folder), "o_orderkey"), path)
    return batches.read_batch(spark, path, 37).select("o_orderkey", "batch_id")


@query("""SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 16 AS batch_id,
(row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS step_id FROM customer""")
def batch_sequential(spark, folder):
    return splitting.sequential_batches(tables.table(spark, folder, "customer").select("c_custkey"), "c_custkey")


@query(f"""WITH {_ranked_orders('42:1')} SELECT (r - 1) // 64 AS step_id, count(*) AS rows,
count(DISTINCT (r - 1) // 16) AS batches FROM ranked GROUP BY (r - 1) // 64""")
def step_groups(spark, folder):
    batched = splitting.shuffled_batches(_orders(spark, folder), "o_orderkey", epoch=1)
    per_batch = batched.groupBy("step_id", "batch_id").agg(F.count("*").alias("n"))
    return per_batch.groupBy("step_id").agg(F.sum("n").alias("rows"), F.count("*").alias("batches"))


# --- training runs ----------------------------------------------------------

@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration
FROM (SELECT event_id, floor(value * 37)::BIGINT AS s FROM events)""")
def format_duration(spark, folder):
    return tables.table(spark, folder, "events").select(
        "event_id", C.duration_text(F.col("value") * 37).alias("duration")
    )


@query("""WITH l AS (SELECT event_id, value, floor(value)::BIGINT AS s, floor(value * 100)::BIGINT AS t FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'epoch' WHEN 1 THEN 'check' WHEN 2 THEN 'final' ELSE 'other' END AS kind,
  CASE WHEN event_id % 4 < 2 THEN (event_id % 50 + 1)::INTEGER END AS epoch,
  CASE WHEN event_id % 4 = 0 THEN 50 END AS epochs,
  CASE WHEN event_id % 4 < 3 THEN value END AS loss,
  CASE WHEN event_id % 4 < 2 THEN s END AS seconds, CASE WHEN event_id % 4 = 0 THEN t END AS total_seconds,
  CASE WHEN event_id % 4 = 2 THEN 0.25::DOUBLE END AS precision,
  CASE WHEN event_id % 4 = 2 THEN 0.5::DOUBLE END AS recall,
  CASE WHEN event_id % 4 IN (1, 2) THEN 0.125::DOUBLE END AS f1 FROM l""")
def run_log_parse(spark, folder):
    form, epoch = F.col("event_id") % 4, F.col("event_id") % 50 + 1
    lines = tables.table(spark, folder, "events").select(
        "event_id",
        F.when(form == 0, run_source.epoch_line(epoch, F.lit(50), "value", "value", F.col("value") * 100))
        .when(form == 1, run_source.check_line(epoch, "value", "value", F.lit(0.125)))
        .when(form == 2, run_source.final_line("value", F.lit(0.25), F.lit(0.5), F.lit(0.125)))
        .otherwise(F.concat(F.lit("note "), F.col("event_type")))
        .alias("value"),
    )
    return run_source.parse_log(lines).drop("value")


@query(f"WITH {HISTORY} SELECT run_id, epoch, value FROM history WHERE epoch % 5 = 0")
def cadence(spark, folder):
    return tables.history(spark, folder).where(C.due("epoch", 5)).select("run_id", "epoch", "value")


@query(f"""WITH {BATCHES} SELECT run_id, epoch, count(*) AS batches, count(*) FILTER (loss IS NULL) AS failed,
round(sum(coalesce(loss, 0)) / count(*), 6) AS mean_loss,
round(sum(loss * n_rows) / sum(CASE WHEN loss IS NOT NULL THEN n_rows END), 6) AS weighted_loss
FROM batches GROUP BY run_id, epoch""")
def epoch_loss(spark, folder):
    losses = runs.epoch_loss(tables.batch_log(spark, folder), rows="rows")
    return losses.withColumns({c: F.round(c, 6) for c in ("mean_loss", "weighted_loss")})


@query(f"""WITH {BATCHES} SELECT run_id, epoch, batch, round(sum(coalesce(loss, 0)) OVER w / (batch + 1), 6) AS running_loss
FROM batches WINDOW w AS (PARTITION BY run_id, epoch ORDER BY batch)""")
def running_loss(spark, folder):
    scanned = runs.running_loss(tables.batch_log(spark, folder))
    return scanned.select("run_id", "epoch", "batch", F.round("running_loss", 6).alias("running_loss"))


# Means of two-decimal values often end on a half; a small shift keeps both roundings on one side.
@query(f"""WITH {HISTORY}, e AS (SELECT run_id, epoch, sum(value) OVER (PARTITION BY run_id ORDER BY epoch) AS s
  FROM history)
SELECT run_id, epoch, round(s + 1e-7, 4) AS elapsed, round(s / epoch + 1e-7, 4) AS mean_epoch,
  round(s / epoch * (200 - epoch) + 1e-7, 4) AS remaining FROM e""")
def epoch_eta(spark, folder):
    scanned = runs.epoch_eta(tables.history(spark, folder), 200, seconds="value")
    names = ("elapsed", "mean_epoch", "remaining")
    return scanned.select("run_id", "epoch", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in names])


@query(f"""WITH {CHECKS} SELECT run_id, epoch, val_loss, least(val_loss, b) AS best, b IS NULL OR val_loss < b AS improved
FROM (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) AS b FROM checks)""")
def best_so_far(spark, folder):
    scanned = runs.best_so_far(tables.checked_history(spark, folder), "val_loss")
    return scanned.select("run_id", "epoch", "val_loss", "best", "improved")


@query(f"""WITH {CHECKS} SELECT run_id, min(val_loss) AS best_loss, arg_min(epoch, (val_loss, epoch)) AS best_epoch
FROM checks GROUP BY run_id""")
def best_epoch(spark, folder):
    return runs.best_epoch(tables.checked_history(spark, folder), "val_loss")


@query(f"""WITH {CHECKS}, marked AS (SELECT run_id, epoch, chk, coalesce(val_loss < min(val_loss) OVER
  (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM checks)
SELECT run_id, epoch, improved, chk - max(CASE WHEN improved THEN chk END) OVER (PARTITION BY run_id ORDER BY epoch)
  AS waited FROM marked""")
def patience_counter(spark, folder):
    counted = runs.patience_counter(tables.checked_history(spark, folder), "val_loss")
    return counted.select("run_id", "epoch", "improved", "waited")


def _stop_sql(patience: int, min_delta: float) -> str:
    better = f"c.val_loss < w.best - {min_delta}::DOUBLE"
    return f"""WITH RECURSIVE {CHECKS}, walk AS (
  SELECT run_id, chk, epoch, val_loss AS best, epoch AS best_epoch, 0 AS waited FROM checks WHERE chk = 1
  UNION ALL
  SELECT c.run_id, c.chk, c.epoch, CASE WHEN {better} THEN c.val_loss ELSE w.best END,
    CASE WHEN {better} THEN c.epoch ELSE w.best_epoch END, CASE WHEN {better} THEN 0 ELSE w.waited + 1 END
  FROM walk w JOIN checks c ON c.run_id = w.run_id AND c.chk = w.chk + 1 WHERE w.waited < {patience})
SELECT run_id, max(CASE WHEN waited >= {patience} THEN epoch END) AS stop_epoch,
  arg_max(best_epoch, chk) AS best_epoch, arg_max(best, chk) AS best_loss FROM walk GROUP BY run_id"""


@query(_stop_sql(10, 0))
def early_stop(spark, folder):
    return runs.early_stop(tables.checked_history(spark, folder), "val_loss")


@query(_stop_sql(3, 0.01))
def early_stop_margin(spark, folder):
    return runs.early_stop(tables.checked_history(spark, folder), "val_loss", patience=3, min_delta=0.01)


@query(f"""WITH RECURSIVE {CHECKS}, walk AS (
  SELECT run_id, chk, epoch, val_loss, val_loss AS best, 0 AS bad, 3e-5::DOUBLE AS lr, true AS improved
  FROM checks WHERE chk = 1
  UNION ALL
  SELECT c.run_id, c.chk, c.epoch, c.val_loss, CASE WHEN better THEN c.val_loss ELSE best END,
    CASE WHEN better OR bad = 3 THEN 0 ELSE bad + 1 END,
    CASE WHEN NOT better AND bad = 3 AND lr - lr * 0.5::DOUBLE > 1e-8::DOUBLE THEN lr * 0.5::DOUBLE ELSE lr END, better
  FROM (SELECT w.best, w.bad, w.lr, c.*, c.val_loss < w.best * (1 - 1e-4::DOUBLE) AS better
        FROM walk w JOIN checks c ON c.run_id = w.run_id AND c.chk = w.chk + 1) c)
SELECT run_id, epoch, val_loss, improved, lr FROM walk""")
def lr_plateau(spark, folder):
    scanned = runs.lr_plateau(tables.checked_history(spark, folder), "val_loss", lr=3e-5)
    return scanned.select("run_id", "epoch", "val_loss", "improved", "lr")


# --- trials -----------------------------------------------------------------

@query(f"""WITH {HISTORY}, s AS (SELECT run_id AS trial, epoch - 1 AS step, value, min(value) OVER (PARTITION BY run_id
  ORDER BY epoch) AS best FROM history),
m AS (SELECT *, median(value) OVER (PARTITION BY step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS middle, count(*) OVER (PARTITION BY step ORDER BY trial) - 1 AS earlier FROM s)
SELECT trial, step, value, best, earlier, round(middle, 6) AS median,
  step >= 5 AND earlier >= 5 AND best > middle AS prune FROM m""")
def median_prune(spark, folder):
    steps = tables.history(spark, folder).select(
        F.col("run_id").alias("trial"), (F.col("epoch") - 1).alias("step"), "value"
    )
    return median.median_prune(steps).withColumn("median", F.round("median", 6))


TRIALS = "trials AS (SELECT user_id AS trial, min(value) AS value FROM events GROUP BY user_id)"


def _trials(spark, folder):
    events = tables.table(spark, folder, "events")
    return events.groupBy(F.col("user_id").alias("trial")).agg(F.min("value").alias("value"))


@query(f"""WITH {TRIALS} SELECT trial, value, min(value) OVER (ORDER BY trial) AS best_value FROM trials""")
def trial_history(spark, folder):
    return trials.trial_history(_trials(spark, folder))


@query(f"WITH {TRIALS} SELECT trial, value FROM trials ORDER BY value, trial LIMIT 1")
def best_trial(spark, folder):
    return trials.best_trial(_trials(spark, folder))


def _space_sql() -> str:
    def u(name: str) -> str:
        return f"(('0x' || md5(c_custkey || ':{name}:42')[1:8])::BIGINT / 4294967296)"

    return f"""SELECT c_custkey AS trial,
round(exp(ln(1e-6::DOUBLE) + {u("learning_rate")} * (ln(1e-4::DOUBLE) - ln(1e-6::DOUBLE))), 12) AS learning_rate,
[8, 16, 32][1 + floor({u("batch_size")} * 3)::INTEGER] AS batch_size,
4 + floor({u("lora_rank")} * 13)::INTEGER AS lora_rank, 16 + floor({u("lora_alpha")} * 49)::INTEGER AS lora_alpha,
round({u("lora_dropout")} * 0.5::DOUBLE, 9) AS lora_dropout,
round(0.1::DOUBLE + {u("gen_weight")} * 0.8::DOUBLE, 9) AS gen_weight,
round(0.9::DOUBLE - {u("gen_weight")} * 0.8::DOUBLE, 9) AS cls_weight FROM customer"""


@query(_space_sql())
def sample_space(spark, folder):
    drawn = trials.sample_space(tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("trial")))
    return drawn.withColumns(
        {"learning_rate": F.round("learning_rate", 12)}
        | {c: F.round(c, 9) for c in ("lora_dropout", "gen_weight", "cls_weight")}
    )


PARAMS = ("l_quantity", "l_discount", "l_tax")


@query("""WITH r AS (SELECT min(l_quantity) AS a1, max(l_quantity) AS b1, min(l_discount) AS a2, max(l_discount) AS b2,
  min(l_tax) AS a3, max(l_tax) AS b3 FROM lineitem),
long AS (SELECT l_extendedprice AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS param,
  unnest([(l_quantity - a1) / (b1 - a1), (l_discount - a2) / (b2 - a2), (l_tax - a3) / (b3 - a3)]) AS x
  FROM lineitem, r),
bins AS (SELECT param, least(floor(x * 10), 9) AS bin, count(*) AS n, avg(y) AS m, var_pop(y) AS v
  FROM long GROUP BY ALL),
g AS (SELECT param, sum(n * m) / sum(n) AS grand FROM bins GROUP BY param)
SELECT param, round(sum(n * (m - grand) ** 2) / (sum(n * (m - grand) ** 2) + sum(n * v)), 6) AS importance
FROM bins JOIN g USING (param) GROUP BY param""")
def param_importance(spark, folder):
    rows = _lineitem(spark, folder, *PARAMS, "l_extendedprice")
    return trials.param_importance(rows, PARAMS, "l_extendedprice").withColumn("importance", F.round("importance", 6))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS value,
unnest(['l_quantity', 'l_discount', 'l_tax']) AS param, unnest([l_quantity, l_discount, l_tax]) AS param_value
FROM lineitem""")
def param_slice(spark, folder):
    rows = _lineitem(spark, folder, *PARAMS, F.col("l_extendedprice").alias("value"))
    return trials.param_slice(rows, PARAMS, [*LINE_KEYS, "value"])


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - a1) / (b1 - a1), 6) AS l_quantity,
round((l_discount - a2) / (b2 - a2), 6) AS l_discount, round((l_tax - a3) / (b3 - a3), 6) AS l_tax,
round((l_extendedprice - a4) / (b4 - a4), 6) AS l_extendedprice FROM lineitem, (SELECT min(l_quantity) AS a1,
max(l_quantity) AS b1, min(l_discount) AS a2, max(l_discount) AS b2, min(l_tax) AS a3, max(l_tax) AS b3,
min(l_extendedprice) AS a4, max(l_extendedprice) AS b4 FROM lineitem)""")
def param_scaled(spark, folder):
    names = (*PARAMS, "l_extendedprice")
    scaled = trials.param_scaled(_lineitem(spark, folder, *names), names)
    return scaled.withColumns({c: F.round(c, 6) for c in names})


FOREST = {"trees": 8, "depth": 5}


@query()
def param_fanova(spark, folder):
    """Shares of the variance by a forest; compared with a grid in the tests, since SQL grows no trees."""
    rows = _lineitem(spark, folder, *PARAMS, "l_extendedprice")
    return importance.param_fanova(rows, PARAMS, "l_extendedprice", **FOREST)


# --- sub-words --------------------------------------------------------------

#: Merges of the query that has SQL.
MERGES = 6
#: Merges of a whole vocabulary: the pieces of the reference's tokenizer (T5-small).
VOCABULARY_MERGES = 32_000


def _merges_sql(merges: int = MERGES) -> str:
    """Merges one at a time: the tables m0, m1 ... hold the best pair, w1, w2 ... the words after it."""
    parts = [
        r"words AS (SELECT unnest(regexp_extract_all(replace(text, '␟', '�'), '[^ \t\n\x0B\f\r]+')) AS word FROM documents)",
        "w0 AS MATERIALIZED (SELECT list_append(regexp_extract_all(word, '(?s).'), '␟') AS s, count(*) AS n FROM words GROUP BY word)",
    ]
    for k in range(merges):
        parts.append(
            f"m{k} AS MATERIALIZED (SELECT l, r, n FROM (SELECT p.l AS l, p.r AS r, sum(n)::BIGINT AS n FROM (SELECT n, unnest(list_transform(range(1, len(s)), "
            f"lambda i: {{'l': s[i], 'r': s[i + 1]}})) AS p FROM w{k}) GROUP BY p.l, p.r) ORDER BY n DESC, encode(l), encode(r) LIMIT 1)"
        )
        # from left to right: a symbol joins the one before it, unless that has just been joined
        parts.append(
            f"w{k + 1} AS MATERIALIZED (SELECT list_reduce(list_prepend([]::VARCHAR[], list_transform(s, lambda x: [x])), lambda a, x: CASE WHEN "
            f"len(a) > 0 AND a[-1] = l AND x[1] = r THEN list_append(a[:-2], l || r) ELSE list_concat(a, x) END) AS s, w{k}.n FROM w{k}, m{k})"
        )
    return "WITH " + ",\n".join(parts)


def _merges(spark, folder):
    counts = subwords.word_counts(tables.documents(spark, folder), "text")
    return stored(counts, "word_counts"), MERGES


@query(_merges_sql() + "\n" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS rank, l AS left, r AS right, n FROM m{k}" for k in range(MERGES)))
def subword_merges(spark, folder):
    return subwords.learn_merges(*_merges(spark, folder))


@query()
def subword_audit(spark, folder):
    """Sub-words of each text, whether 512 ids cut it, and whether its ids give the text back.

    The vocabulary is as large as the reference's, whose merges follow from one another; compared
    with merging one pair at a time in the tests, since SQL would need a table for each merge.
    """
    docs = tables.documents(spark, folder).select("doc_id", "text")
    counts, _ = _merges(spark, folder)
    known = subwords.subwords(counts, subwords.learn_merges(counts, VOCABULARY_MERGES))
    ids = subwords.encode_subwords(docs, "text", known, ["doc_id", "text"]).withColumnRenamed("text", "given")
    back = subwords.decode_subwords(ids, "ids", known)
    same = F.col("text") == F.coalesce(subwords.clean("given"), F.lit(""))
    return back.select("doc_id", "n_subwords", (F.col("n_subwords") > 511).alias("truncated"), same.alias("same_text"))


# --- learning ---------------------------------------------------------------

@query("""SELECT count(*) AS rows, 1 AS missing, 'conclusion' AS missing_names, false AS usable FROM labels""")
def input_check(spark, folder):
    return learning.require_columns(
        tables.table(spark, folder, "labels"), ["doc_id", "quality", "toxic", "conclusion"]
    )


CLASSIFIER_REG = 0.01


def _classifier(rows: DataFrame, part: str):
    """The classifier fitted on the rows of a condition, and its coefficients for the unscaled features."""
    model = learning.classifier(["features"], "risk", max_iter=500, reg=CLASSIFIER_REG, tol=1e-13)
    model = model.fit(learning.complete_rows(rows.where(part), ["features"]))
    scaler, logistic = model.stages[1], model.stages[2]
    return model, [c / s if s else 0.0 for c, s in zip(logistic.coefficients, scaler.std)]


def _risk_rows(spark, folder, array) -> DataFrame:
    rows = tables.table(spark, folder, "embeddings").select("vec_id", C.zero_label("label").alias("risk"), array.alias("x"))
    return learning.vector_column(rows, "x")


@query("""SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings)))::INTEGER AS feature, 0.0::DOUBLE AS residual""")
def train_classifier(spark, folder):
    """A fit on all features solves the score equation of each feature; a fit on anything else does not."""
    rows = _risk_rows(spark, folder, F.col("embedding").cast("array<double>"))
    model, coefficients = _classifier(rows, "true")
    scored = learning.decisions(model, rows, ["x", "risk"])
    found = search.score_equations(scored, "x", "risk", "probability", coefficients, CLASSIFIER_REG)
    return found.select("feature", *_rounded(4, residual=F.col("residual")))


FEATURES = 3


def _block_means(n: int = FEATURES):
    """Means of ``n`` equal parts of an embedding."""
    vector = F.transform("embedding", lambda v: v.cast("double"))
    size = F.floor(F.size("embedding") / n).cast("int")
    parts = [F.slice(vector, F.lit(i) * size + 1, size) for i in range(n)]
    return F.array(*[F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / size for p in parts])


def _newton_sql(grid: str, held_out: str, tests: str, scale: bool, steps: int = 12) -> str:
    """Logistic fits in SQL, by Newton steps whose 4 x 4 systems are solved column by column.

    ``grid`` gives trial, reg and positive_weight; ``held_out`` lists the folds of table x
    that a fit leaves out. The result is table b (trial, fold, weights c0 to c3).
    """
    n = FEATURES + 1
    size = f"(len(embedding) // {FEATURES})"
    means = ", ".join(
        f"list_sum(list_transform(embedding[{i} * {size} + 1:{i + 1} * {size}], lambda v: v::DOUBLE)) / {size} AS r{i + 1}"
        for i in range(FEATURES)
    )
    scaled = ", ".join(
        f"(r{i} - (SELECT avg(r{i}) FROM raw WHERE {tests})) / (SELECT stddev_samp(r{i}) FROM raw WHERE {tests}) AS x{i}" if scale
        else f"r{i} AS x{i}" for i in range(1, n)
    )
    parts = [
        f"raw AS MATERIALIZED (SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y, {means} FROM embeddings)",
        f"x AS MATERIALIZED (SELECT vec_id, y, 1.0::DOUBLE AS x0, {scaled}, {held_out} AS part FROM raw)",
        f"b0 AS MATERIALIZED (SELECT trial, reg, positive_weight, fold, {', '.join(f'0.0::DOUBLE AS c{i}' for i in range(n))} "
        f"FROM ({grid}) g, (SELECT DISTINCT part AS fold FROM x WHERE part >= 0) f)",
    ]
    for k in range(steps):
        margin = " + ".join(f"c{i} * x{i}" for i in range(n))
        weight = "CASE WHEN y = 1 THEN positive_weight ELSE 1 END"
        keys = "trial, reg, positive_weight, fold, " + ", ".join(f"c{i}" for i in range(n))
        sums = [f"sum(w * (p - y) * x{i}) / sum(w){f' + reg * c{i}' if i else ''} AS g{i}" for i in range(n)]
        sums += [f"sum(w * p * (1 - p) * x{i} * x{j}) / sum(w){' + reg' if i == j and i else ''} AS h{i}{j}" for i in range(n) for j in range(n)]
        body = (
            f"SELECT {keys}, {', '.join(sums)} FROM (SELECT *, {weight} AS w, 1 / (1 + exp(-({margin}))) AS p "
            f"FROM b{k} JOIN x ON x.part != b{k}.fold) GROUP BY {keys}"
        )
        for i in range(n):  # clear column i from all other rows
            columns = []
            for r in range(n):
                factor = f"h{r}{i} / h{i}{i}"
                columns.append(f"g{r} AS g{r}" if r == i else f"g{r} - {factor} * g{i} AS g{r}")
                columns += [f"h{r}{c} AS h{r}{c}" if r == i else f"h{r}{c} - {factor} * h{i}{c} AS h{r}{c}" for c in range(n)]
            body = f"SELECT {keys}, {', '.join(columns)} FROM ({body})"
        steps_taken = ", ".join(f"c{i} - g{i} / h{i}{i} AS c{i}" for i in range(n))
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT trial, reg, positive_weight, fold, {steps_taken} FROM ({body}))")
    parts.append(f"b AS (SELECT * FROM b{steps})")
    return "WITH " + ",\n".join(parts)


_MARGIN = " + ".join(f"c{i} * x{i}" for i in range(FEATURES + 1))


@query(_newton_sql("SELECT 0 AS trial, 0.01 AS reg, 1.0 AS positive_weight", "CASE WHEN vec_id % 5 = 0 THEN 0 ELSE -1 END", "vec_id % 5 != 0", True) + f"""
, s AS (SELECT y, {_MARGIN} AS score FROM x, b WHERE part = 0),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place FROM s)
SELECT unnest(['intercept', 'x1', 'x2', 'x3', 'held-out auc']) AS name, round(unnest([c0, c1, c2, c3,
  (SELECT (sum(place) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
   / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM r)]), 4) + 0.0 AS value FROM b""")
def classifier_fit(spark, folder):
    """Weights of the scaled features fitted on four fifths of the rows, and the AUC on the rest."""
    rows = _risk_rows(spark, folder, _block_means())
    model, _ = _classifier(rows, "vec_id % 5 != 0")
    logistic = model.stages[2]
    # centred features: the weights apply to (x - mean) / deviation
    named = [("intercept", logistic.intercept), *((f"x{i + 1}", c) for i, c in enumerate(logistic.coefficients))]
    fitted = spark.createDataFrame([(n, float(c)) for n, c in named], "name string, value double")
    auc = classes.roc_auc(learning.decisions(model, rows.where("vec_id % 5 = 0"), ["risk"]), "risk", "probability")
    both = fitted.union(auc.select(F.lit("held-out auc"), F.col("roc_auc")))
    return both.select("name", *_rounded(4, value=F.col("value")))


TRIAL_GRID = """SELECT (row_number() OVER (ORDER BY reg, positive_weight) - 1)::INTEGER AS trial, reg, positive_weight
FROM (SELECT unnest([0.001, 0.01, 0.1, 1.0])::DOUBLE AS reg), (SELECT unnest([1.0, 2.0, 4.0])::DOUBLE AS positive_weight)"""


@query(_newton_sql(TRIAL_GRID, "vec_id % 3", "true", False) + f"""
SELECT trial, reg, positive_weight, round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -1 ELSE 1 END * ({_MARGIN})))), 6) AS value,
count(*) AS rows, true AS converged FROM b JOIN x ON x.part = b.fold GROUP BY trial, reg, positive_weight""")
def search_trials(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(
        _block_means().alias("x"), C.zero_label("label").alias("risk"), (F.col("vec_id") % 3).alias("fold")
    )
    grid = [(i, r, w) for i, (r, w) in enumerate((r, w) for r in (0.001, 0.01, 0.1, 1.0) for w in (1.0, 2.0, 4.0))]
    found = search.search_trials(
        rows, spark.createDataFrame(grid, "trial int, reg double, positive_weight double"), "x", "risk"
    )
    return found.trials.withColumn("value", F.round("value", 6))


def _share_of_spaces(batch: pd.DataFrame) -> pd.Series:
    return batch["text"].str.count(" ") / batch["text"].str.len()


@query("""SELECT doc_id, round((len(text) - len(replace(text, ' ', ''))) / len(text), 6) AS prediction, false AS failed,
NULL::VARCHAR AS error FROM documents""")
def batch_score(spark, folder):
    scored = learning.batch_score(
        tables.documents(spark, folder), _share_of_spaces, ["doc_id"], ["text"], batch_size=64
    )
    return scored.withColumn("prediction", F.round("prediction", 6))


def _shares(model: str, batch: pd.DataFrame) -> list[dict]:
    """Loss and text of every row; fails for texts without the mark that the model asks for."""
    if not batch["text"].str.contains(model, regex=False).all():
        raise ValueError("no mark")
    loss = batch["text"].str.count(" ") / batch["text"].str.len()
    return [{"loss": a, "text": b} for a, b in zip(loss, batch["text"].str.slice(0, 20))]


@query("""SELECT doc_id, CASE WHEN contains(text, '.') THEN round((len(text) - len(replace(text, ' ', ''))) / len(text), 6) END AS loss,
CASE WHEN contains(text, '.') THEN substr(text, 1, 20) END AS text, NOT contains(text, '.') AS failed,
CASE WHEN NOT contains(text, '.') THEN 'ValueError: no mark' END AS error FROM documents""")
def score_isolated(spark, folder):
    """Loss and text from one call; texts that the predictor cannot take fail alone."""
    docs = tables.documents(spark, folder)
    scored = learning.score_rows(docs, lambda: ".", _shares, ["doc_id"], ["text"])
    return scored.select("doc_id", F.round("result.loss", 6).alias("loss"), "result.text", "failed", "error")


@query("""WITH r AS (SELECT l.quality AS y, l.toxic AS p, CASE WHEN l.doc_id % 13 <> 0 THEN n_chars / 1000 END AS loss,
  l.doc_id % 7 = 0 AS blank, lang FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT count(*) AS n, sum(coalesce(loss, 0)) AS s, count_if(blank OR lang IS NULL) AS bad, count_if(loss IS NULL) AS gaps,
  count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp, count_if(y = 0 AND p = 0) AS tn, count_if(y = 1 AND p = 0) AS fn FROM r)
SELECT unnest(['rows', 'loss', 'accuracy', 'f1', 'sensitivity', 'specificity', 'rejected', 'missing_loss', 'missing_input']) AS metric,
round(unnest([n, s / n, (tp + tn) / (tp + fp + tn + fn), 2 * tp / (2 * tp + fp + fn), tp / (tp + fn), tn / (tn + fp), bad, gaps, n]), 9) AS value FROM m""")
def evaluate_once(spark, folder):
    """Metrics and input checks that are collected while the predictions are written."""
    labels, docs = tables.table(spark, folder, "labels"), tables.documents(spark, folder)
    rows = labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"),
        F.when(F.col("doc_id") % 13 != 0, F.col("n_chars") / 1000).alias("loss"),
        F.when(F.col("doc_id") % 7 == 0, " ").otherwise("x").alias("prediction"), F.col("lang").alias("reference"),
    )
    found = evaluate_while_writing(rows, new_folder(spark, "predictions"), required=["loss", "input"])
    return found.withColumn("value", F.round("value", 9))


@query(f"""WITH {HISTORY} SELECT run_id, epoch, CASE WHEN epoch % 2 = 0 THEN value + 1 ELSE value END AS loss,
CASE WHEN epoch % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS attempt FROM history""")
def history_appends(spark, folder):
    """Histories appended in three parts, one of them twice, compacted in between; the last attempt counts."""
    rows = tables.history(spark, folder).select("run_id", "epoch", F.col("value").alias("loss"), F.lit(1).alias("attempt"))
    store = KeyedAppends(spark, new_folder(spark, "history"), attempt="attempt")
    first, second = rows.where("epoch % 3 = 0"), rows.where("epoch % 3 != 0")
    again = rows.where("epoch % 2 = 0").withColumns({"loss": F.col("loss") + 1, "attempt": F.lit(2)})
    for part in (again, first, first):
        store.append(part)
    store.compact()
    store.append(second)
    return store.read()


# --- files out and in -------------------------------------------------------

@query("""SELECT doc_id, text AS "Conclusion (Tr)", CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '28-35'
ELSE lang END AS "Cycle", CASE WHEN doc_id % 4 = 0 THEN (n_chars % 90)::INTEGER END AS "r:AgeInYears",
CASE WHEN doc_id % 6 <> 0 THEN n_chars / 7 END AS "R0 int", source FROM documents""")
def read_case_file(spark, folder):
    """Documents written as a delimited case file and read back, texts with line breaks and quotes included."""
    key, size = F.col("doc_id"), F.col("n_chars")
    cycle = F.when(key % 5 == 0, "n/a").when(key % 5 == 1, "").when(key % 5 == 2, "28-35").otherwise(F.col("lang"))
    years = (size % 90).cast("string")  # 3.0 is a whole number, 3.5 is none
    cases = tables.documents(spark, folder).select(
        "doc_id", F.col("text").alias("Conclusion (Tr)"), cycle.alias("Cycle"),
        F.concat(years, F.when(key % 4 == 0, ".0").otherwise(".5")).alias("r:AgeInYears"),
        F.when(key % 6 == 0, F.lit(float("nan"))).otherwise(size / 7).alias("R0 int"), "source",
    )
    path = new_folder(spark, "cases")
    case_source.write_table(cases, path, "csv")
    read = case_source.read_cases(spark, path)
    return read.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(_wide_sql())
def processed_cases(spark, folder):
    """A case file labelled, normalised, written beside its input and read back."""
    path = f"{new_folder(spark, 'raw')}/cases.csv"
    case_source.write_table(tables.wide_cases(spark, folder), path, "csv", compression="gzip")
    prepare_cases(spark, path, multi_line=False)
    done = spark.read.parquet(case_source.processed_path(path))
    keys = [F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber")]
    return _clean(done.select(*keys, "cancer_risk", *WIDE), *WIDE)


@query(f"""WITH {SPLIT} SELECT split, o_orderkey, count(*) OVER (PARTITION BY split) AS rows FROM split""")
def stored_splits(spark, folder):
    """Splits stored on the first call and only read on the second; each is read out of its own folder."""
    path = new_folder(spark, "splits")
    orders = _orders(spark, folder)
    case_source.splits_or_create(spark, path, lambda: splitting.exact_split(orders, "o_orderkey"))
    found = case_source.splits_or_create(spark, path, lambda: orders.withColumn("split", F.lit("made again")))
    parts = [found.where(F.col("split") == name) for name in ("train", "val", "test")]
    rows = found.groupBy("split").agg(F.count("*").alias("rows"))
    return parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(rows), "split").select("split", "o_orderkey", "rows")


@query(_newton_sql("SELECT unnest([0, 1]) AS trial, unnest([0.01, 1.0]) AS reg, 1.0 AS positive_weight", "CASE WHEN vec_id % 5 = 0 THEN 0 ELSE -1 END", "vec_id % 5 != 0", True) + """
SELECT CASE trial WHEN 0 THEN 'best' ELSE 'epoch 5' END AS model, unnest(['intercept', 'x1', 'x2', 'x3']) AS name,
round(unnest([c0, c1, c2, c3]), 4) + 0.0 AS value FROM b""")
def stored_models(spark, folder):
    """Weights of the best model, which replaced a former best one, and of a periodic one, all read from files."""
    rows = learning.complete_rows(_risk_rows(spark, folder, _block_means()).where("vec_id % 5 != 0"), ["features"])
    strict, loose = (
        learning.classifier(["features"], "risk", max_iter=500, reg=reg, tol=1e-13).fit(rows) for reg in (1.0, CLASSIFIER_REG)
    )
    path = new_folder(spark, "models")
    run_source.save_epoch(strict, path, 5)
    for model in (strict, loose):
        run_source.save_best(model, path)
    found = {"best": run_source.load_best(path), "epoch 5": run_source.load_model(current(f"{path}/checkpoint_epoch_5"))}
    weights = [
        (kind, name, float(value))
        for kind, model in found.items()
        for name, value in zip(("intercept", "x1", "x2", "x3"), (model.stages[2].intercept, *model.stages[2].coefficients))
    ]
    return spark.createDataFrame(weights, "model string, name string, value double").select(
        "model", "name", *_rounded(4, value=F.col("value"))
    )


@query(f"""WITH {TRIALS}, best AS (SELECT trial FROM trials ORDER BY value, trial LIMIT 1)
SELECT trial, value, trial IN (SELECT trial FROM best) AS best FROM trials""")
def stored_trials(spark, folder):
    """Trials and the best of them, published twice: what is read is the second version of both."""
    path = new_folder(spark, "trials")
    done = _trials(spark, folder)
    for part in (done.where("trial % 2 = 0"), done):
        run_source.write_trials(part, trials.best_trial(part), path)
    every, best = run_source.read_trials(spark, path)
    won = F.broadcast(best.select("trial", F.lit(True).alias("best")))
    return every.join(won, "trial", "left").select("trial", "value", F.coalesce("best", F.lit(False)).alias("best"))
