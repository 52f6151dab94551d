"""Line dedup by content-defined line chunks, with DataFrame functions only.

Each line has a hash; a rolling hash combines it with the next line's.  A chunk ends where the
rolling hash is a local minimum, so boundaries depend on nearby lines only: lines put in front of
a passage move no boundary inside it.  Chunks have two lines at least, but for the first and last
of a text.  Multi-line chunks whose hash occurs more than once are compared byte by byte, and all
but the first occurrence (smallest id, then position) are removed.

An end needs lines beyond a short passage, so :func:`local_minima` misses most passages of a few lines.
:func:`line_pairs` is the densest cut: each two adjacent lines are a chunk, whose boundaries depend on
its own lines alone.  Chunks overlap, so the matched ones join up to the whole of each repeated run.

Hashes are counted with map-side aggregation; only chunks that share a hash are grouped as text, and
the first occurrence of a chunk goes back to its rows by its hash, a hot one by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from .common import bounded_broadcast, join_by_key, let, written

#: Repeated hashes (8 bytes) are broadcast up to this count; changed documents (id and spans) up to
#: these counts of documents and of spans.
BROADCAST_HASHES, BROADCAST_DOCS, BROADCAST_SPANS = 500_000, 100_000, 1_000_000


def rolling(hashes: Column) -> Column:
    """The hash of each line and the one after it (the last: of itself); ``hashes`` is named many times."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.coalesce(F.get(hashes, i + 1), F.lit(0).cast("long"))))


def ends(rolled: Column) -> Column:
    """The numbers of the lines after which a chunk ends: local minima, and the last line."""
    low = F.lit(-(1 << 63)).cast("long")
    at = F.transform(
        rolled,
        lambda r, i: F.when(
            (i == F.size(rolled) - 1) | ((r < F.coalesce(F.get(rolled, i - 1), low)) & (r <= F.coalesce(F.get(rolled, i + 1), low))), i
        ),
    )
    return F.filter(at, lambda x: x.isNotNull())


#: Of the lines of a text, its chunks: an array of (start, n, hash, [chunk]), the text of a chunk if asked for.
Cut = Callable[[Column, bool], Column]


def local_minima(lines: Column, texts: bool) -> Column:
    """The multi-line chunks between local minima of the rolling hash."""

    def spans(at: Column) -> Column:
        each = F.transform(at, lambda e, i: F.struct((F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1).alias("start"), e.alias("end")))
        return F.transform(F.filter(each, lambda s: s["end"] > s["start"]), made)

    def made(s: Column) -> Column:
        n = s["end"] - s["start"] + 1
        return let(F.array_join(F.slice(lines, s["start"] + 1, n), "\n"), lambda c: F.struct(s["start"].alias("start"), n.alias("n"), F.xxhash64(c).alias("hash"), *[c.alias("chunk")] * texts))

    return let(F.transform(lines, lambda line: F.xxhash64(line)), lambda h: let(rolling(h), lambda r: let(ends(r), spans)))


def line_pairs(lines: Column, texts: bool) -> Column:
    """As :func:`local_minima`, with each two adjacent lines as a chunk; two lines of white space are none."""

    def pair(i: Column) -> Column:
        a, b = F.get(lines, i), F.get(lines, i + 1)
        blank = (F.btrim(a, F.lit(BLANK)) == "") & (F.btrim(b, F.lit(BLANK)) == "")
        made = F.struct(i.alias("start"), F.lit(2).alias("n"), F.xxhash64(a, b).alias("hash"), *[F.concat(a, F.lit("\n"), b).alias("chunk")] * texts)
        return F.when(~blank, made)

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - 2), pair), lambda x: x.isNotNull())


BLANK = " \t\n\x0b\x0c\r"


def chunked(docs: DataFrame, id_col: str, text_col: str, cut: Cut = local_minima, texts: bool = True) -> DataFrame:
    """(doc_id, mark, start, n, hash, [chunk]) of each chunk; mark is a hash of the whole text.

    The lines are an array that is made once a text, so a text costs time in proportion to its lines.
    """
    found = let(F.split(F.col(text_col), "\n", -1), lambda lines: cut(lines, texts))
    rows = exploded(docs.filter(F.instr(F.col(text_col), "\n") > 0), found, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), names=("place", "c"))
    return rows.select("doc_id", "mark", "c.*")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "line-dedup", cut: Cut = local_minima) -> DataFrame:
    """(doc_id, mark, gone): per changed document the spans (start, n) to remove."""
    again = chunked(docs, id_col, text_col, cut, texts=False).groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    again = written(again.filter("times > 1").select("hash"), label)
    rows = written(chunked(docs, id_col, text_col, cut).join(bounded_broadcast(again, BROADCAST_HASHES), "hash", "left_semi"), label)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    # Byte comparison: chunks are alike where the whole text is the key.
    alike = rows.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    firsts = alike.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"))
    firsts = written(firsts, label)
    total, mixed = firsts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count_if(F.col("kinds") > 1)).first()
    met = join_by_key(rows.drop("chunk"), firsts.filter("kinds = 1").drop("kinds"), ["hash"], total, "n_rows").drop("hash")
    if mixed:  # different chunks under one hash: few, as the hash has 64 bits
        own = rows.join(bounded_broadcast(firsts.filter("kinds > 1").select("hash"), BROADCAST_HASHES), "hash", "left_semi")
        own = own.join(alike.select("hash", "chunk", "first"), ["hash", "chunk"]).drop("hash", "chunk")
        met = met.unionByName(own)
    later = met.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", F.struct("start", "n").alias("span"))
    return written(later.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("gone")), label)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "line-dedup", cut: Cut = local_minima) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated chunks, n_lines, removed_lines.

    With ``cut=line_pairs`` each later occurrence of a repeated run of two or more lines goes whole.

    A null text stays null with no lines; an empty text has one empty line; null ids count as larger
    than any other.  Rows that repeat both id and text are one document and get the same result.  A
    text of one line is never changed, as chunks have more than one.
    """
    gone = repeats(docs, id_col, text_col, label, cut)
    n_docs, n_spans = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if n_docs <= BROADCAST_DOCS and n_spans <= BROADCAST_SPANS:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "gone")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = rows.join(gone, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left")

    def left(lines: Column) -> Column:
        # Spans may overlap; sets of line numbers keep this linear in the lines of a text.
        lost = F.array_distinct(F.flatten(F.transform("gone", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
        return F.struct(text.alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))

    met = met.withColumn("left", F.when(F.col("gone").isNotNull(), let(F.split("text", "\n", -1), left)))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return met.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("left.removed", F.lit(0)).cast("long").alias("removed_lines"),
    )
