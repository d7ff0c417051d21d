"""Case tables: schema, delimited files in, processed and split tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.columns import na_to_null
from caseloom.operators.regression import KINDS, POSITIONS

# Column names of a case table, in file order.
TEXT_COLUMNS = (
    "Hormonal medications", "Cancer family history", "Breast operations", "Conclusion (Tr)",
)
AGE_COLUMN = "r:AgeInYears"
CYCLE_COLUMNS = ("Cycle", "Day from the first day", "Num of pregnancies")
CONTROL_COLUMNS = ("T1 int", "T2 int", "T1 sk", "T2 sk")
READING_COLUMNS = tuple(f"{s}{p} {k}" for k in KINDS for s in ("L", "R") for p in POSITIONS)
GRADE_COLUMN = "r:Th"

#: Lines of a compressed delimited file.
FILE_LINES = 1_000_000

CASE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField(AGE_COLUMN, T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in CYCLE_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in (*CONTROL_COLUMNS, *READING_COLUMNS)]
    + [T.StructField(GRADE_COLUMN, T.DoubleType())]
)


def read_cases(
    spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """Read delimited files by header name; missing-value tokens become null.

    Columns of the schema that the file lacks stay absent; others are kept as
    text. Set ``multi_line=False`` when no text holds a line break: large files
    can then be split among tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    types = {f.name: f.dataType for f in schema.fields}

    def typed(name: str):
        clean = na_to_null(F.col(f"`{name}`"))
        kind = types.get(name, T.StringType())
        if isinstance(kind, T.IntegerType):  # 3.0 is a whole number, too
            number = clean.try_cast("double")
            clean = F.when(number == F.floor(number), number.try_cast("int"))
        elif not isinstance(kind, T.StringType):
            clean = clean.try_cast(kind)
        return clean.alias(name)

    return raw.select(*[typed(c) for c in raw.columns])


def write_table(df: DataFrame, path: str, format: str = "parquet", compression: str | None = None) -> None:
    """Write a table; compressed delimited files are kept short, since each is read by one task."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if format == "csv":
        if compression:
            # the default level takes twice the time for 5 % less
            writer = writer.option("maxRecordsPerFile", FILE_LINES).option("zlib.compress.level", "FOUR")
        writer = writer.option("header", True).option("escape", '"')
        # blanks around a text are part of it
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(format).save(path)


def processed_path(path: str) -> str:
    """``folder/name`` becomes ``folder/processed_name``."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}processed_{name}"


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One table with a partition folder per split, so that reading one split prunes the rest."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its marker in ``path``."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def splits_or_create(spark: SparkSession, path: str, create: Callable[[], DataFrame]) -> DataFrame:
    """Read stored splits, or make and store them first."""
    if not is_complete(spark, path):
        write_splits(create(), path)
    return spark.read.parquet(path)
