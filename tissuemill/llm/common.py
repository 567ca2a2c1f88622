"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at a time.
SLICE_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Only on one machine (a local master) a temporary folder
    may take its place; anywhere else its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tissuemill-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` wrote, once everything read from them has itself been written."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, which it does once the driver has let go of their plans."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the package on the workers; a worker gives free memory back after each task."""
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return df.mapInArrow(tidy, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece hold about `most` bytes (one long text may hold more)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): words of text i are vocabulary[codes[offsets[i]:offsets[i + 1]]].

    Null and empty texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    vocabulary = coded.dictionary
    blank = pc.index(vocabulary, "").as_py() if len(vocabulary) else -1
    if blank >= 0:  # white space at either end of a text leaves an empty string
        real = codes != blank
        before = np.concatenate(([0], np.cumsum(real)))
        codes, offsets = codes[real], before[offsets]
    return offsets, codes, vocabulary


def hash_strings(strings: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of unsigned 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
