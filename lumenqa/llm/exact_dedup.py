"""Exact dedup by a log-structured merge index.

* A *memtable* is the rows of one task: it is sorted by digest and flushed as a run, a Parquet
  file whose row groups carry Bloom filters and digest ranges.
* *Compaction* merges runs into a level: one entry per digest, sorted, with the smallest identifier
  and the count.  :class:`Index` holds levels; new memtables probe the filters of the levels before
  them, and levels of like size are merged, so that an entry is written again only a few times
  however many batches come.
* A *filter* is a bit table over a hash of the digests.  Rows whose bit is not set are alone and are
  joined with nothing.
* A digest that occurs more than once is a *hit*; hits receive byte verification by grouping on
  the whole normalised text, so that two texts which merely share a digest stay apart.

Only digests and ids are shuffled for compaction; texts are shuffled for hits only, and equal ones
collapse in the map-side aggregation first, so a hot group of copies costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, columns_of, free_prefix, join_by_key, written

#: Hits are broadcast up to this count (64 hex digits each: under 10 MB); above it they are shuffled.
BROADCAST_HITS = 100_000
#: A filter has 16 bits an entry, within these bounds; its words of 64 bits, at most a million, are broadcast.
BITS_AN_ENTRY, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 26
#: Levels are merged when so many are of like size.
FAN_IN = 4
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text.

    The pattern matches only the runs that differ from one space, which gives the same text with
    far fewer matches.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def flush_runs(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], label: str, shift: int = 0) -> DataFrame:
    """Level 0: (doc_id, row_id, digest), each task's rows sorted by digest and written as one run.

    Row ids start at ``shift`` times 2^53, so those of different batches don't meet.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.monotonically_increasing_id() + F.lit(shift << 53).cast("long")).alias("row_id"),
        digest(normalised(F.col(text_col))).alias("digest"),
    )
    return written(rows.sortWithinPartitions("digest"), label, **_BLOOM)


def compact(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One entry per key: the smallest (doc_id, row_id), nulls last, and the number of rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    return runs.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("group_size"))


def lookup(runs: DataFrame, digests: list[str]) -> DataFrame:
    """The run entries of a few digests; ranges and Bloom filters skip the other row groups."""
    return runs.filter(F.col("digest").isin(digests))


@dataclass
class Filter:
    """A bit table over the hashes of digests, as (word, bits) rows of the words that are not zero."""

    words: DataFrame
    bits: int

    @staticmethod
    def of(entries: DataFrame, count: int, label: str) -> Filter:
        """``entries`` has ``count`` rows with a digest."""
        bits = LEAST_BITS
        while bits < min(MOST_BITS, BITS_AN_ENTRY * count):
            bits *= 2
        at = F.pmod(F.xxhash64("digest"), F.lit(bits))
        rows = entries.select(F.shiftright(at, 6).alias("word"), _bit(at).alias("bit"))
        return Filter(written(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")), label), bits)

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``maybe``: false where the digest is surely none of the entries."""
        at = F.pmod(F.xxhash64("digest"), F.lit(self.bits))
        words = F.broadcast(self.words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))  # at most MOST_BITS / 64
        met = rows.join(words, F.shiftright(at, 6) == F.col("__word"), "left")
        return met.select(*columns_of(rows), F.coalesce(F.col("__bits").bitwiseAND(_bit(at)) != 0, F.lit(False)).alias("maybe"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


@dataclass
class Level:
    """Sorted entries (digest, first, group_size), one a digest, and their filter."""

    entries: DataFrame
    count: int
    rows: int
    filter: Filter


@dataclass
class Index:
    """Levels, oldest first; a digest may have an entry in several of them."""

    spark: SparkSession
    label: str
    levels: list[Level] = field(default_factory=list)
    batches: int = 0

    def _level(self, entries: DataFrame) -> Level:
        entries = written(entries.sortWithinPartitions("digest"), self.label, **_BLOOM)
        count, rows = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
        return Level(entries, count, rows, Filter.of(entries, count, self.label))

    def known(self, runs: DataFrame) -> DataFrame:
        """(digest, first, group_size) of the digests of ``runs`` that a level has: only what passes a filter is joined."""
        asked, out = runs.select("digest").distinct(), None
        for level in self.levels:
            some = level.filter.probe(asked).filter("maybe").drop("maybe")
            found = level.entries.join(some, "digest", "left_semi").select("digest", "first", "group_size")
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], runs.select("digest").schema).join(compact(runs, ["digest"]), "digest")
        return merged(out)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
        """Takes a batch of documents in; its runs (doc_id, row_id, digest)."""
        runs = flush_runs(docs, id_col, text_col, digest, self.label, self.batches)
        self.batches += 1
        self.levels.append(self._level(compact(runs, ["digest"])))
        while len(self.levels) >= FAN_IN and self.levels[-FAN_IN].count < FAN_IN * max(1, sum(x.count for x in self.levels[1 - FAN_IN :])):
            last = self.levels[-FAN_IN:]
            entries = last[0].entries
            for level in last[1:]:
                entries = entries.unionByName(level.entries)
            self.levels[-FAN_IN:] = [self._level(merged(entries))]
        return runs

    def entries(self) -> DataFrame:
        """One entry per digest over all levels."""
        out = self.levels[0].entries
        for level in self.levels[1:]:
            out = out.unionByName(level.entries)
        return out if len(self.levels) == 1 else merged(out)


def merged(entries: DataFrame) -> DataFrame:
    """Entries of several levels as one a digest: compaction keeps the smallest identifier."""
    return entries.groupBy("digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    label: str = "exact-dedup",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical after :func:`normalised`.  The row with the smallest id stays;
    a null id is larger than any other, and of repeated rows with the same id one stays.  An
    empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    index = Index(docs.sparkSession, label)
    runs = index.add(docs, id_col, text_col, digest)
    level = index.levels[0]
    hits = written(level.entries.filter("group_size > 1"), label)
    n_hits, n_rows = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    if not n_hits:
        return _decided(runs.withColumns({"first": F.lit(None).cast(level.entries.schema["first"].dataType), "group_size": F.lit(None).cast("long")}))
    found = Filter.of(hits, n_hits, label)
    # Byte verification of what may be a hit; a text that only shares a filter bit is one group more.
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("whole"))
    texts = texts.withColumn("digest", digest(F.col("whole")))
    kinds = found.probe(texts).filter("maybe").groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n"))
    several = written(kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), label)
    # Rows whose bit is not set are alone; the others meet the hits, a hot one by broadcast.
    probed = found.probe(runs)
    met = join_by_key(probed.filter("maybe").drop("maybe"), hits.withColumn("n", F.col("group_size")), ["digest"], n_rows, how="left")
    alone = probed.filter("not maybe").drop("maybe")
    out = _decided(met.unionByName(alone, allowMissingColumns=True))
    if several.isEmpty():
        return out
    # Different texts under one digest: the whole text is the key.
    several = bounded_broadcast(several, BROADCAST_HITS)
    own = written(texts.withColumn("row_id", F.monotonically_increasing_id()).join(several, "digest", "left_semi"), label)
    entries = written(compact(own, ["digest", "whole"]).withColumn("n", F.col("group_size")), label)
    verified = join_by_key(own, entries, ["digest", "whole"], own.count())
    return out.join(several, "digest", "left_anti").unionByName(_decided(verified), allowMissingColumns=True).select(*out.columns)


def _decided(rows: DataFrame) -> DataFrame:
    """The verdict on rows with the entry of their digest; a row without one is alone."""
    entry = F.col("group_size").isNotNull()
    return rows.select(
        "doc_id", "row_id", "digest", F.when(entry, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), F.when(entry, F.col("row_id") == F.col("first.row_id")).otherwise(True).alias("kept"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "exact-dedup") -> DataFrame:
    """``docs`` without the rows that have an earlier equal text; all columns as they were.

    Dropped ids are removed by an anti join where every row of an id goes.  Where rows repeat an
    id that stays, the surviving row is chosen by its text, so a repeated row is kept once.
    """
    decided = written(deduplicate(docs, id_col, text_col, label=label), label)
    gone = decided.filter(~F.col("kept"))
    prefix = free_prefix(docs)
    # One counter per (id, digest): how many of its rows stay (0 or 1).
    verdict = gone.select(F.col("doc_id").alias(prefix + "id"), F.col("digest").alias(prefix + "digest")).distinct()
    kept_too = decided.filter("kept and group_size > 1").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    drop = verdict.join(
        kept_too, verdict[prefix + "id"].eqNullSafe(kept_too["kept_id"]) & (verdict[prefix + "digest"] == kept_too["kept_digest"]), "left_anti"
    )
    drop = bounded_broadcast(written(drop, label), BROADCAST_HITS)
    tagged = docs.withColumn(prefix + "key", sha256(normalised(F.col(text_col))))
    left = tagged.join(drop, tagged[id_col].eqNullSafe(drop[prefix + "id"]) & (F.col(prefix + "key") == drop[prefix + "digest"]), "left_anti")
    return _once(left, decided, id_col, docs.columns, prefix)


def _once(left: DataFrame, decided: DataFrame, id_col: str, names: list[str], prefix: str) -> DataFrame:
    """Rows repeated under one id and digest are kept once; the test for such rows reads ids of copies only."""
    columns = columns_of(left, names)
    again = decided.filter("group_size > 1").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return left.select(*columns)
    again = again.select(F.col("doc_id").alias(prefix + "id"), F.col("digest").alias(prefix + "digest"))
    match = left[id_col].eqNullSafe(again[prefix + "id"]) & (F.col(prefix + "key") == again[prefix + "digest"])
    alone = left.join(again, match, "left_anti").select(*columns)
    first = F.min(F.struct(*columns)).alias(prefix + "row")
    several = left.join(again, match, "left_semi").groupBy(F.col(id_col).alias(prefix + "id"), prefix + "key").agg(first)
    return alone.unionByName(several.select(prefix + "row.*"))
