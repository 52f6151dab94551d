"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  Two
fingerprints that differ in at most ``distance`` bits agree on ``blocks - distance`` of the
``blocks`` bit blocks, so they meet in a join on one of those block choices; the Hamming distance
is then verified.  Only distinct fingerprints are joined, so copies of a text never meet.

A bucket with more than ``bucket_rows`` fingerprints is not paired up.  Its fingerprints take an
exact linear way instead: each emits itself and its 64 one-bit neighbours as meeting points.  Two
fingerprints differ in at most two bits exactly if they share a meeting point, and a meeting point
has at most 65 members, so nothing grows with the square of a bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import HOT_KEYS, Batches, bounded_broadcast, columns_of, free_prefix, hex64, join_by_key, map_rows, tidied, written
from .components import connected_components

SEED = 42
#: Ids to drop are broadcast up to this count (8 bytes each); above it they are shuffled.
BROADCAST_IDS = 500_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text; null and wordless texts give zero.

    A-Z are lower-cased, words are split at ASCII white space, shingles count as often as they
    occur, and a text with fewer words than a shingle is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, fp as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {id_type}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, label: str, distance: int = 2, blocks: int = 5, bucket_rows: int = 32) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all pairs within ``distance`` bits.

    ``distinct`` has each fingerprint once, in column fp.  Every link is verified.
    """
    if distance > 2:
        raise ValueError("the exact way for large buckets covers distances up to 2")
    masks = block_masks(blocks, distance)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", choice.alias("at")).select("fp", "at.block", "at.key")
    counts = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("times", F.col("n"))
    members = written(join_by_key(keyed, counts, ["block", "key"], len(masks) * distinct.count(), "times"), label)

    small = members.filter(F.col("n") <= bucket_rows)
    left, right = small.select("block", "key", F.col("fp").alias("a")), small.select("block", "key", F.col("fp").alias("b"))
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["block", "key"]).filter("a < b").filter(within).select("a", "b")

    large = members.filter(F.col("n") > bucket_rows).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = large.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").filter(within)
    return pairs.unionAll(star).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 5,
    bucket_rows: int = 32,
    label: str = "simhash",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, the document's own included; null ids
    count as larger than any other, so a component of null ids alone has a null component_id.
    Texts without words share the fingerprint zero and are linked like any others.  Repeated rows
    give repeated results; an empty table gives none.  Other columns are not read.
    """
    groups = _grouped(docs, id_col, text_col, shingle, distance, blocks, bucket_rows, label)
    return groups.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, distance: int = 2, blocks: int = 5, bucket_rows: int = 32, label: str = "simhash"
) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row; root is the component's least fingerprint."""
    marks = written(fingerprints(docs, id_col, text_col, shingle), label)
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("times")), label)
    total, each = classes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    found = connected_components(links(classes.select("fp"), label, distance, blocks, bucket_rows), label)
    rooted = classes.join(found, classes["fp"] == found["node"], "left")
    rooted = written(rooted.select("fp", "first_id", "times", F.coalesce("root", "fp").alias("root")), label)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = join_by_key(rooted, least, ["root"], each).select("fp", "root", "component_id", "times")
    if each > HOT_KEYS:
        classes = written(classes, label)
    return join_by_key(marks, classes, ["fp"], total, "times").select("doc_id", "fp", "root", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "simhash", **options: int) -> DataFrame:
    """``docs`` with one row of each group: one whose id is the component id.

    Rows with a null id stay (they can't be told apart by id).  Rows that repeat an id are decided by id
    and fingerprint, so a near copy under an id leaves another text under it alone.
    """
    groups = written(_grouped(docs, id_col, text_col, label=label, **options), label)
    prefix = free_prefix(docs)
    name = prefix + "gone"
    several = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = written(several.select(F.col("doc_id").alias(name)), label)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    repeated = not several.isEmpty()
    if repeated:  # all rows of a repeated id leave the main path
        gone = gone.unionByName(several).distinct()
    gone = bounded_broadcast(written(gone, label), BROADCAST_IDS)
    left = docs.join(gone, docs[id_col] == gone[name], "left_anti")
    return left.unionByName(_first_rows(docs, groups, several, id_col, text_col, prefix, options.get("shingle", 3))) if repeated else left


def _first_rows(docs: DataFrame, groups: DataFrame, several: DataFrame, id_col: str, text_col: str, prefix: str, shingle: int) -> DataFrame:
    """Of the rows under repeated ids, one for each component that has its smallest id there."""
    several = bounded_broadcast(several, BROADCAST_IDS)
    rows = docs.join(several, docs[id_col] == several[prefix + "gone"], "left_semi")
    at, name = docs.columns.index(text_col), prefix + "fp"

    def run(batches: Batches) -> Batches:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], [str(i) for i in range(batch.num_columns + 1)])

    rows = map_rows(rows, run, [StructField(name, LongType())])
    roots = groups.filter(F.col("doc_id") == F.col("component_id")).join(several, F.col("doc_id") == F.col(prefix + "gone"), "left_semi")
    roots = roots.select(F.col("doc_id").alias(prefix + "id"), F.col("fp").alias(prefix + "mark"), F.col("root").alias(prefix + "root")).distinct()
    met = rows.join(roots, (rows[id_col] == roots[prefix + "id"]) & (rows[name] == roots[prefix + "mark"]))
    first = F.min(F.struct(*columns_of(docs))).alias(prefix + "row")
    return met.groupBy(prefix + "root").agg(first).select(prefix + "row.*")
