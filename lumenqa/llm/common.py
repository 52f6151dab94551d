"""Shared helpers: the written scratch tables that cut lineage, and small readers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.columns import let
from ..sources.scratch import release, scratch_path, shared_root, spread, written

#: What the word-based contracts call white space, as a Java regular-expression class body.
SPACE = r"\x20\x09-\x0D"

#: A key with a greater share of the rows than one in so many is hot, so there are at most so many.
HOT_KEYS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hex digits (two's complement)."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` starts with: helper columns named so clash with none."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of ``df`` whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, n_col: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by ``keys``, inner or left, however many rows share a key.

    ``table`` has one row a key; its column ``n_col``, which is not returned, says how many of the
    rows have the key, ``total`` of them in all.  Hot keys hold more than one row in ``HOT_KEYS``, so
    there are at most that many: they are broadcast, and no task gets all rows of one.  The others
    are shuffled.
    """
    hot = F.col(n_col) * HOT_KEYS >= total
    broadcast = F.broadcast(table.filter(hot).drop(n_col))
    if total <= HOT_KEYS:  # every key is hot
        return rows.join(broadcast, keys, how)
    rest = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(broadcast, keys).unionByName(rest.join(table.filter(~hot).drop(n_col), keys, how))


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow; at the end of a task the worker gives free memory back to the system.

    Workers outlive their task, and an idle one would hold on to the most it ever used.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, run: Callable[[Batches], Batches], added: list[StructField]) -> DataFrame:
    """mapInArrow over whole rows, their columns of any name; ``run`` yields batches with the added ones last.

    ``run`` sees columns by place only, and gives its batches any names.
    """
    fields = [StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema)]
    names = [f.name for f in fields] + [f"d{i}" for i in range(len(added))]
    schema = StructType(fields + [StructField(n, f.dataType) for n, f in zip(names[len(fields) :], added, strict=True)])

    def named(batches: Batches) -> Batches:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return df.toDF(*names[: len(fields)]).mapInArrow(tidied(named), schema).toDF(*df.columns, *[f.name for f in added])


__all__ = [
    "HOT_KEYS", "SPACE", "Batches", "bounded_broadcast", "columns_of", "crc_fold", "free_prefix", "hex64", "join_by_key", "let", "map_rows", "read", "release", "scratch_path", "shared_root",
    "tidied", "written",
]
