"""Wide CSV files in and out, and archives of result files."""

from __future__ import annotations

import csv
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.qc import coerce


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_wide_csv(spark: SparkSession, path: str, key: str = "gene", column: str = "bulk_col", value: str = "value") -> DataFrame:
    """key, column, value: one row for each cell of a CSV whose first column is the key.

    What is not a number counts as 0. A file without value columns is an error, one without rows gives no rows.
    """
    wide = spark.read.csv(path, header=True)
    first, *others = wide.columns
    if not others:
        raise ValueError(f"{path}: no column beside the key")
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.col(quoted(c)).alias("v")) for c in others))
    return wide.select(F.col(quoted(first)).alias(key), F.inline(cells).alias(column, "_raw")).select(key, column, coerce(F.col("_raw")).alias(value))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tissuemill-files")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a short plan, and nothing to compute again when an executor is lost."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_features(features: DataFrame, path: str, width: int) -> None:
    """Features (further columns, then f) as a folder of CSV files with columns 0 to width - 1; made if absent, replaced if there."""
    others = [c for c in features.columns if c != "f"]
    features.select(*others, *(F.get("f", F.lit(k)).alias(str(k)) for k in range(width))).write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table of CSV files, its columns 0, 1, ... as numbers; an absent or empty one is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.csv(path, header=True)
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df.select(*(coerce(F.col(quoted(c))).alias(c) if c.isdigit() else F.col(quoted(c)) for c in df.columns))


def preview(spark: SparkSession, path: str, rows: int = 5, columns: int = 8) -> DataFrame:
    """The first rows and columns of a CSV file."""
    df = spark.read.csv(path, header=True)
    return df.select(*map(quoted, df.columns[:columns])).limit(rows)


def oriented(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    """bulk_col, cell_type, p of a wide table whose first column names its rows, whichever way it lies.

    Classes are the rows, unless all classes are columns and not all are rows.
    """
    first, *others = table.columns
    named = {r[0] for r in table.select(quoted(first)).collect()}  # classes or bulk samples
    turned = set(classes) <= set(others) and not set(classes) <= named
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.col(quoted(c)).cast("double").alias("v")) for c in others))
    long = table.select(F.col(quoted(first)).alias("r"), F.inline(cells))
    row, column = ("c", "r") if turned else ("r", "c")
    return long.select(F.col(column).alias("bulk_col"), F.col(row).alias("cell_type"), F.col("v").alias("p"))


def props_table(props: DataFrame, classes: Sequence[str]) -> DataFrame:
    """props (bulk_col, cell_type, p) as one row for each class: index, then a column for each bulk sample; absent is 0.

    The classes come in the order given, others after them by name.
    """
    given = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    place = F.array_position(given, F.col("index"))
    wide = props.groupBy(F.col("cell_type").alias("index")).pivot("bulk_col").agg(F.first("p")).fillna(0.0)
    every = wide.sparkSession.createDataFrame([(c,) for c in classes], "index string").join(wide, "index", "full").fillna(0.0)
    return every.orderBy(place == 0, place, "index")


def write_props(props: DataFrame, classes: Sequence[str], path: str) -> DataFrame:
    """props_table as one CSV with a row number under a blank header; a file that is there is replaced, even a read-only one.

    The table has classes x bulk samples numbers.
    """
    table = props_table(props, classes)
    target = Path(path)
    part = target.with_name(target.name + ".part")
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        with part.open("w", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(["", *table.columns])
            rows.writerows([i, *row] for i, row in enumerate(table.collect()))
        os.replace(part, target)
    except OSError as error:
        raise PermissionError(f"{path} cannot be written: {error}") from error
    return table


def pack(files: Sequence[str], path: str) -> list[str]:
    """Deflated archive of files under their own names; replaces one that is there, but not if a file is missing."""
    missing = [f for f in files if not Path(f).is_file()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    names = [Path(f).name for f in files]
    if len(set(names)) < len(names):
        raise ValueError("two files of one name")
    target = Path(path)
    part = target.with_name(target.name + ".part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as out:
        for f, name in zip(files, names, strict=True):
            out.write(f, name)
    os.replace(part, target)
    return names
