"""Risk classifier, batch scoring with a caller's predictor, and parameter search."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType


def vector_column(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    """Turn an array column into a feature vector."""
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def classifier(
    inputs: Sequence[str],
    label: str = "cancer_risk",
    max_iter: int = 50,
    reg: float = 0.01,
    tol: float = 1e-6,
) -> Pipeline:
    """Assemble, scale and fit a two-class logistic regression.

    Fit it on :func:`complete_rows`; :func:`decisions` keeps rows with gaps.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="__raw", handleInvalid="error"),
            StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True),
            LogisticRegression(
                featuresCol="__scaled", labelCol=label, predictionCol="decision", maxIter=max_iter, regParam=reg,
                tol=tol,
            ),
        ]
    )


def _complete(df: DataFrame, columns: Sequence[str]) -> Column:
    """No null in the columns, and no NaN in those that are numbers."""
    kinds = dict(df.dtypes)
    gaps = [F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(False)) for c in columns]
    return ~reduce(or_, gaps)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows to fit on."""
    return df.where(_complete(df, columns))


def decisions(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Decision and probability of class 1 for every row; null where an input is missing."""
    whole = _complete(df, model.stages[0].getInputCols())
    scored = model.transform(df.where(whole)).select(
        *keep,
        F.col("decision").cast("int").alias("decision"),
        vector_to_array("probability")[1].alias("probability"),
    )
    rest = df.where(~whole).select(*keep, F.lit(None).cast("int").alias("decision"), F.lit(None).cast("double").alias("probability"))
    return scored.union(rest)


def batch_score(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence],
    keep: Sequence[str],
    inputs: Sequence[str],
    result_type: str = "double",
    batch_size: int = 16,
    name: str = "prediction",
) -> DataFrame:
    """Run a predictor over batches on the executors.

    ``predict`` gets the input columns of up to ``batch_size`` rows. When it
    raises, the rows of that batch get a null prediction, are marked failed, and
    ``error`` says why.
    """
    table = df.select(*keep, *[c for c in inputs if c not in keep])
    schema = table.select(*keep, F.lit(None).cast(result_type).alias(name), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error")).schema

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, errors = [], []
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start : start + batch_size]
                try:
                    found, error = list(predict(batch[list(inputs)])), None
                    if len(found) != len(batch):
                        raise ValueError(f"{len(found)} predictions for {len(batch)} rows")
                except Exception as reason:  # the batch is marked, the others go on
                    found, error = [None] * len(batch), f"{type(reason).__name__}: {reason}"
                values += found
                errors += [error] * len(batch)
            out = frame[list(keep)].copy()
            out[name] = pd.Series(values, index=out.index)
            out["failed"] = [e is not None for e in errors]
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            yield out

    return table.mapInPandas(score, schema)


def bisected(predict: Callable[[pd.DataFrame], Sequence], batch: pd.DataFrame) -> list[tuple[object, str | None]]:
    """(result, error) of every row: a batch that fails is halved until the bad rows stand alone.

    A bad row takes at most two more calls for each halving of its batch.
    """
    try:
        found = list(predict(batch))
        if len(found) != len(batch):
            raise ValueError(f"{len(found)} predictions for {len(batch)} rows")
        return [(value, None) for value in found]
    except Exception as reason:  # the good rows of the batch are scored all the same
        if len(batch) == 1:
            return [(None, f"{type(reason).__name__}: {reason}")]
        half = len(batch) // 2
        return bisected(predict, batch.iloc[:half]) + bisected(predict, batch.iloc[half:])


_LOADED: dict[str, object] = {}


def score_rows(
    df: DataFrame,
    load: Callable[[], object],
    predict: Callable[[object, pd.DataFrame], Sequence],
    keep: Sequence[str],
    inputs: Sequence[str],
    result_type: str = "struct<loss:double,text:string>",
    batch_size: int = 64,
    name: str = "result",
) -> DataFrame:
    """Run a loaded model over batches on the executors; one bad row costs only itself.

    ``load`` is called once in each worker, ``predict`` gets what it returned and the input
    columns of up to ``batch_size`` rows, and returns a value of ``result_type`` for each
    row (a mapping for a struct). Rows for which it raises on their own have a null result,
    ``failed`` set and ``error`` saying why. Kept columns come first; an empty table stays empty.
    """
    table = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, *inputs])))
    places = {c: f"c{i}" for i, c in enumerate(table.columns)}
    key = uuid.uuid4().hex
    own = ", ".join(f"{places[c]} {table.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{own}, result {result_type}, failed boolean, error string"
    result = DataType.fromDDL(result_type)

    def plain(value):
        if isinstance(result, StructType) and value is not None:
            return {f.name: value.get(f.name) for f in result.fields}
        return value

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = load()
        model, kind = _LOADED[key], to_arrow_type(result)
        for batch in batches:
            frame = batch.select([places[c] for c in inputs]).to_pandas()
            frame.columns = list(inputs)
            found = []
            for start in range(0, len(frame), batch_size):
                found += bisected(lambda rows: predict(model, rows), frame.iloc[start : start + batch_size])
            columns = [batch.column(places[c]) for c in keep]
            columns += [
                pa.array([plain(value) for value, _ in found], kind),
                pa.array([error is not None for _, error in found], pa.bool_()),
                pa.array([error for _, error in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*(places[c] for c in keep), "result", "failed", "error"])

    scored = table.toDF(*places.values()).mapInArrow(score, schema)
    return scored.toDF(*keep, name, "failed", "error")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One-row report: is the table non-empty, and which columns are missing?"""
    missing = [c for c in required if c not in df.columns]
    rows = df.agg(F.count("*").alias("rows"))
    return rows.select(
        "rows",
        F.lit(len(missing)).alias("missing"),
        F.lit(",".join(missing)).alias("missing_names"),
        ((F.col("rows") > 0) & F.lit(not missing)).alias("usable"),
    )


def search(
    df: DataFrame,
    estimator: Pipeline,
    evaluator: Evaluator,
    grid: Sequence[Mapping],
    train: float = 0.8,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[DataFrame, PipelineModel]:
    """Fit every parameter map and return the trials table and the best model.

    The objective is minimised: a metric that grows with quality is negated.
    """
    tuned = TrainValidationSplit(
        estimator=estimator,
        estimatorParamMaps=list(grid),
        evaluator=evaluator,
        trainRatio=train,
        parallelism=parallelism,
        seed=seed,
    ).fit(df)
    sign = -1.0 if evaluator.isLargerBetter() else 1.0
    # a parameter is named by its stage as well when two stages have one of that name
    params = sorted({p for point in grid for p in point}, key=lambda p: (p.name, p.parent))
    shared = Counter(p.name for p in params)
    names = [p.name if shared[p.name] == 1 else f"{p.parent.rpartition('_')[0]}_{p.name}" for p in params]
    columns = [[point.get(p) for point in grid] for p in params]
    types = [_type_of(c) for c in columns]
    records = [
        (trial, *[None if c[trial] is None else t[1](c[trial]) for c, t in zip(columns, types)], sign * metric)
        for trial, metric in enumerate(tuned.validationMetrics)
    ]
    schema = "trial int, " + "".join(f"`{n}` {t[0]}, " for n, t in zip(names, types)) + "value double"
    return df.sparkSession.createDataFrame(records, schema), tuned.bestModel


def _type_of(values: Sequence) -> tuple[str, Callable]:
    """Column type and conversion for a parameter's values; absent ones are null."""
    known = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in known):
        return "boolean", bool
    if all(isinstance(v, int) for v in known):
        return "bigint", int
    if all(isinstance(v, (int, float)) for v in known):
        return "double", float
    return "string", str


def parameter_maps(drawn: DataFrame, params: Mapping[str, Param], trial: str = "trial") -> list[dict[Param, object]]:
    """Rows of a sampled search space as parameter maps, in order of trial.

    ``params`` names the stage parameter of each used column. The trials of one
    search are few: every one is a whole fit.
    """
    rows = drawn.select(trial, *params).orderBy(trial).collect()
    return [{param: row[name] for name, param in params.items() if row[name] is not None} for row in rows]
