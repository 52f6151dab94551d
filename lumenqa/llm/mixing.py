"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted the same number of times, r = target / source size: it is
taken floor(r) times, and once more with inclusion probability r - floor(r).  The *flight* moves
these probabilities along directions in the null space of the balancing constraints (documents,
tokens), so both totals keep their expected values while one probability at a time becomes 0 or 1.

The flight runs in blocks of a source, in parallel; a block ends with at most two fractional
probabilities, which meet in the blocks of the next level, 128 blocks to one, until each source
has one block.  There the few that remain *land*: the 0/1 choice nearest to the wanted tokens.
Hot sources have more blocks, not larger ones.
"""

from __future__ import annotations

import math
import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded_broadcast, columns_of, free_prefix, written

#: Ids of several rows are broadcast up to this count.
BROADCAST_REPEATED = 500_000
EPS = 1e-9
#: Level-0 rows a block, and blocks that meet in one of the next level.
BLOCK_ROWS, FAN_IN = 256, 128
#: Up to this many sources the shares are worked out on the driver, else by distributed rounds.
DRIVER_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space; null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def shares(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Targets in proportion to the weights that sum to ``total``, none above cap * size.

    What a capped source can't take is shared again by weight among the others.  If all are
    capped, the targets sum to less.
    """
    targets, open_, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = cap * sizes[i]
        left -= sum(targets[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return targets


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, label: str) -> DataFrame:
    """One row per source: source, source_index, docs, source_size, target."""
    spark = sized.sparkSession
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), label)
    # Code point order, null last; ranks come from partition offsets, not from one sorted task.
    ordered = per.orderBy(F.col("source").isNull(), F.col("source"))
    schema = "source string, source_size long, docs long, source_index long"
    n = per.count()
    if n <= DRIVER_SOURCES:
        rows = ordered.select("source", "source_size", "docs").collect()
        w = [weights[i % len(weights)] for i in range(n)]
        sizes = [r["source_size"] for r in rows]
        targets = shares(sizes, w, share * sum(sizes), cap)
        data = [(r["source"], r["source_size"], r["docs"], i, t) for i, (r, t) in enumerate(zip(rows, targets, strict=True))]
        return spark.createDataFrame(data, schema + ", target double")
    ranked = spark.createDataFrame(ordered.select("source", "source_size", "docs").rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    at = F.col("source_index") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), label)
    return share_rounds(ranked, share, cap)


def share_rounds(ranked: DataFrame, share: float, cap: float) -> DataFrame:
    """As :func:`shares`, by one aggregate a round over (source_size, weight): for many sources.

    A source is capped when level * weight > cap * size; the level only rises, so a round needs
    nothing but the last level.
    """
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        row = ranked.agg(
            F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (total - row[0]) / row[1]
    return ranked.withColumn("target", F.when(over, cap * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))).drop("weight")


def flight(probabilities: list[float], sizes: list[int], rng: random.Random) -> None:
    """Moves ``probabilities`` in place until at most two are strictly between 0 and 1.

    Both sum(p) and sum(p * size) stay as they are.  Units enter in the given order, so those that
    remain open come from its end.
    """
    p, held = probabilities, []
    for unit in range(len(p)):
        if not EPS < p[unit] < 1 - EPS:
            p[unit] = float(round(p[unit]))
            continue
        held.append(unit)
        while len(held) == 3:
            i, j, k = held
            a, b, c = sizes[i], sizes[j], sizes[k]
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)  # null space of (1, 1, 1) and (a, b, c)
            up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(held, u, strict=True) if d)
            down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(held, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for x, d in zip(held, u, strict=True):
                p[x] += step * d
                if p[x] < EPS or p[x] > 1 - EPS:
                    p[x] = float(p[x] > 0.5)
            held = [x for x in held if 0 < p[x] < 1]


def land(probabilities: list[float], sizes: list[int]) -> None:
    """The landing: the open units (at most two) take the 0/1 values nearest to their tokens."""
    held = [i for i, x in enumerate(probabilities) if 0 < x < 1]
    wanted = sum(probabilities[i] * sizes[i] for i in held)
    docs = sum(probabilities[i] for i in held)
    choice = min(product((0.0, 1.0), repeat=len(held)), key=lambda z: (abs(sum(a * sizes[i] for a, i in zip(z, held, strict=True)) - wanted), abs(sum(z) - docs), z))
    for i, x in zip(held, choice, strict=True):
        probabilities[i] = x


def balanced_counts(
    sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1, label: str = "mixing"
) -> DataFrame:
    """How often each row of ``sized`` (row_id, doc_id, source, size) is taken.

    Returns doc_id, row_id, size, source_size, target, times.  A source without words has target 0
    and is taken 0 times.  The draw depends only on ids, sizes, sources and the seed; for rows without
    an id also on their place in the files.
    """
    targets = written(source_targets(sized, weights, share, cap, label), label)
    few = targets.count() <= DRIVER_SOURCES // 10
    right = targets.withColumnRenamed("source", "__source")
    wanted = sized.join(F.broadcast(right) if few else right, sized["source"].eqNullSafe(F.col("__source"))).drop("__source", "source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.least(ratio, F.lit(float(cap)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_ROWS))
    level = wanted.select(
        "row_id", "doc_id", "size", "source_size", "target", "source_index",
        F.floor(ratio).cast("long").alias("base"),
        (ratio - F.floor(ratio)).alias("p"),
        blocks.cast("long").alias("blocks"),
        # Rows without an id are told apart by their place, so that no block gets them all.
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.when(F.col("doc_id").isNull(), F.col("row_id"))), blocks).cast("long").alias("block"),
    )
    most = targets.agg(F.max("docs")).first()[0] or 0
    levels = 1
    while math.ceil(most / BLOCK_ROWS) > FAN_IN ** (levels - 1):
        levels += 1
    schema, done = level.schema, []
    for depth in range(levels):
        fly = _flown(seed, depth)
        level = written(level.groupBy("source_index", "block").applyInPandas(fly, schema), label)
        done.append(level.filter("p = 0 or p = 1"))
        level = level.filter("p > 0 and p < 1").withColumns(
            {"blocks": F.ceil(F.col("blocks") / FAN_IN), "block": F.floor(F.col("block") / FAN_IN)}
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "row_id", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("times"))


def _flown(seed: int, depth: int):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "row_id"], ascending=[False, True, True])  # small documents stay open longest
        p, sizes = rows["p"].tolist(), rows["size"].tolist()
        flight(p, sizes, random.Random(f"{seed}/{depth}/{rows['source_index'].iloc[0]}/{rows['block'].iloc[0]}"))
        if rows["blocks"].iloc[0] == 1:  # the only block of its source
            land(p, sizes)
        return rows.assign(p=p)

    return fly


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, row_id, source, size) of each row; the whole text is counted."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
        F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", label: str = "mixing", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_id, size, source_size, target, times, taken.

    taken is size * times.  Null sources form a source of their own, null texts have size 0,
    repeated rows are units of their own, and an empty table gives an empty result.
    """
    sized = written(sized_documents(docs, id_col, text_col, source_col), label)
    return balanced_counts(sized, label=label, **options).withColumn("taken", F.col("size") * F.col("times"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", label: str = "mixing", **options) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, with its own columns.

    Times are joined back by id; rows that repeat an id are told apart by source, size and number.
    """
    prefix, columns = free_prefix(docs), columns_of(docs)
    at, own, words, number, times = (prefix + x for x in ("id", "source", "size", "number", "times"))
    sized = written(sized_documents(docs, id_col, text_col, source_col), label)
    counts = written(balanced_counts(sized, label=label, **options), label)
    again = written(counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), label)
    repeated = not again.isEmpty()
    again = bounded_broadcast(again.select(F.col("doc_id").alias(at)), BROADCAST_REPEATED)
    by_id = counts.select(F.col("doc_id").alias(own), F.col("times").alias(times))
    alone = docs
    if repeated:
        alone = docs.join(again, docs[id_col].eqNullSafe(again[at]), "left_anti")
        by_id = by_id.join(again, by_id[own].eqNullSafe(again[at]), "left_anti")
    # Every document has a row here, so this is a shuffled join at any size: one pass of the texts.
    joined = alone.hint("merge").join(by_id.hint("merge"), alone[id_col].eqNullSafe(by_id[own])).select(*columns, times)
    if repeated:
        # Rows alike in id, source and size weigh the same: whichever of them gets which times, all totals hold.
        rows = docs.join(again, docs[id_col].eqNullSafe(again[at]), "left_semi")
        rows = rows.withColumns({own: F.col(source_col).cast("string"), words: word_count(F.col(text_col))})
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(id_col, own, words).orderBy(F.xxhash64(text_col))))
        deal = counts.join(sized.select("row_id", "source"), "row_id").join(again, counts["doc_id"].eqNullSafe(again[at]), "left_semi")
        deal = deal.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("row_id")))
        deal = deal.select(*[F.col(c).alias(prefix + "of_" + c) for c in ("doc_id", "source", "size", "number")], F.col("times").alias(times))
        keys = zip((id_col, own, words, number), ("doc_id", "source", "size", "number"), strict=True)
        same = [rows[a].eqNullSafe(deal[prefix + "of_" + b]) for a, b in keys]
        joined = joined.unionByName(rows.join(deal, same).select(*columns, times))
    return joined.filter(F.col(times) > 0).withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*columns)


__all__ = ["apply_mix", "balanced_counts", "flight", "land", "mix", "shares", "share_rounds", "sized_documents", "word_count"]
