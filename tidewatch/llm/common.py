"""Helpers shared by the corpus operators: scratch tables, whole-text columns, hashing of words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, for bytes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written to the folder the cluster shares, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir; where that is unset on one machine (a local master) a temporary folder
    stands in, on a cluster it is an error. Each instance owns a folder of its own; ``drop`` removes a table that is no longer
    read, ``close`` all of them, once nothing reads what was made from them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str, partition: list[str] | None = None) -> str:
        """Write ``df`` and return its path."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return path

    def read(self, path: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here."""
        return self.read(self.write(df, name), df.schema)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        self.drop(self.root)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def fold_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_ids(batch: pa.RecordBatch, rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The batch's doc_id column, as it came, beside one column for each of ``types``."""
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    arrays = [pa.array(values, kind) for values, kind in zip(columns, types.values(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *types])


def strings(column: pa.Array, many: int = 256) -> Iterator[str | None]:
    """A column's values, made into Python strings some at a time."""
    for at in range(0, len(column), many):
        yield from column.slice(at, many).to_pylist()


#: What operators keep in a worker between their tasks.
_KEPT: list[dict] = []


def keep_between_tasks(cache: dict) -> dict:
    """``cache``, which an operator's workers keep until a task of another operator comes."""
    _KEPT.append(cache)
    return cache


def drop_kept() -> None:
    for cache in _KEPT:
        cache.clear()


def give_back() -> None:
    """Unused memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches that gives unused memory back at its end, as a worker lives on after a task.

    What other operators keep in the worker goes first, unless ``work`` is of an operator that ``keeps``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        yield from work(batches)
        give_back()

    return run


#: Words of 64 bits in the filter of ``split_by_ids``: a megabyte, whatever the tables.
FILTER_WORDS = 1 << 17


def split_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among ``ids``, and those whose key surely isn't.

    Each id sets one bit of a filter of FILTER_WORDS words; its size is fixed, so it is broadcast, and rows with whole texts
    that no join needs are told apart before any shuffle. On tables too large for it, the filter lets more rows through.
    """
    word = F.expr(f"cast(pmod(xxhash64({key}), {64 * FILTER_WORDS}) div 64 as int)")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    words = ids.select(word.alias("__word"), bit.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    marked = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.filter(test).select(*quoted(rows)) for test in (maybe, ~maybe))
