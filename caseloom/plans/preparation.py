"""From raw case files to labelled, normalised, split and batched tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from caseloom.operators.regression import label_and_normalise
from caseloom.operators.splitting import exact_split
from caseloom.session import stored, stored_meanwhile
from caseloom.sources.cases import processed_path, read_cases, write_table


def prepare_cases(spark: SparkSession, path: str, format: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Scan, label and normalise one file; store the result beside it and return it.

    The file is parsed once: the typed table is stored while the stages read it.
    """
    out = processed_path(path)
    with stored_meanwhile(read_cases(spark, path, multi_line=multi_line), "cases") as cases:
        write_table(label_and_normalise(cases), out, format, compression=None if format == "csv" else "zstd")
    if format == "csv":
        return read_cases(spark, out, multi_line=multi_line)
    return spark.read.format(format).load(out)


def split_and_prepare(
    cases: DataFrame, id_column: str = "case_id", seed: int = 42, group_by: Sequence[str] = ("split",)
) -> DataFrame:
    """Split first, then label and normalise; by default with coefficients per split.

    The split is stored, since every stage of the normalisation reads it.
    """
    return label_and_normalise(stored(exact_split(cases, id_column, seed), "split"), group_by=group_by)
