"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_by_key, written


def _stars(links: DataFrame, center: str, other: str, total: int) -> DataFrame:
    """Per center: the least of itself and its neighbours, joined back to the links."""
    least = links.groupBy(center).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("n"))
    return join_by_key(links, least.withColumn("least", F.least(center, "least")), [center], total)


def large_star(links: DataFrame, total: int) -> DataFrame:
    """``links`` has ``total`` rows, or fewer."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _stars(both, "a", "b", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def small_star(links: DataFrame, total: int) -> DataFrame:
    """Links with a > b."""
    joined = _stars(links, "a", "b", total)
    ends = F.explode(F.array("b", "a")).alias("a")
    return joined.select(ends, F.col("least").alias("b")).filter("a <> b").distinct()


def connected_components(links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every end of a link, root being the least node reachable.

    ``links`` has long columns a and b.  Each round is written to the shared folder; the driver
    sees two checksums a round, never links.  A center with many links is no task's alone.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = written(links, label), None
    for _ in range(max_rounds):
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = tuple(mark)
        larger = large_star(links, mark[0])
        if mark[0] > HOT_KEYS:  # the plan of a small table is short enough to run both steps at once
            larger = written(larger, label)
        links = written(small_star(larger, mark[0]), label)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
