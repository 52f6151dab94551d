"""Best-fit packing of tokenised documents into sequences.

Items are pieces of at most ``capacity`` tokens; a sequence has three capacities: tokens, document
count and attention cost (the sum of squared piece lengths).  Vector best-fit: pieces go in by
falling length, each into the open sequence that is best by the norm of its weighted residual
after placement (or by the weighted dot product of item and residual), under every constraint.

Pieces of one length are alike, so the packing is planned on the histogram of lengths, at most
``capacity`` numbers however many documents there are.  The plan is a list of ranges: the pieces
number a to b of length L go into sequences from s on, k to a sequence, at offset o.  A piece finds
its range by its number among the pieces of its length, which comes from counts per (length,
bucket), so no length, however common, has to meet in one task.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, tidied, written

END_ID = 1
#: Numbers are given within (length, bucket) of so many pieces at most, on average, and buckets
#: enough that a common length is spread over tasks.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 256
#: Bytes of known words that a tokenising worker holds, in two generations; they go at the end of a task.
CACHE_BYTES = 64 << 20
#: A dictionary entry with its key and value objects takes about so many bytes besides their contents.
_ENTRY_BYTES = 170


def _latin_class(kind: str) -> str:
    """The characters up to U+00FF, lower case, whose Unicode category starts with ``kind``."""
    import unicodedata

    return "".join(f"\\x{i:02x}" for i in range(256) if unicodedata.category(chr(i))[0] == kind and chr(i).lower() == chr(i))


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Ids of what stands between white space, made when first asked for.

    ``size`` estimates the bytes held; ``old`` is the generation before, from which what is met again
    is taken back.
    """

    def __init__(self, ids: Callable[[str], bytes], cut: Callable[[str], list[str]], old: dict[str, bytes]) -> None:
        self.ids, self.cut, self.old, self.size = ids, cut, old, 0

    def __missing__(self, chunk: str) -> bytes:
        raw = self.old.get(chunk)
        if raw is None:
            words = [chunk] if chunk.isalpha() else self.cut(chunk)
            raw = self.ids(chunk) if len(words) == 1 else b"".join([self[w] for w in words])
        self[chunk] = raw
        self.size += len(chunk) + len(raw) + _ENTRY_BYTES
        return raw


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts whose characters all lie in Latin-1 are cut into words by the vocabulary's own pattern, and
    the vocabulary's model gives the ids of each word that isn't known yet; that gives the same ids
    as the whole tokenizer, much faster.  Any other text, and any text that could hold a special
    token, goes to the tokenizer whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        splits = [p.get("pattern", {}).get("Regex") for p in steps]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits == [pattern, None] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        letters, numbers = _latin_class("L"), _latin_class("N")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        names = byte_letters()
        self.letters = {i: "".join(names[b] for b in chr(i).encode()) for i in range(256)}
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        """Drops all known words."""
        self.words = _Words(self.ids, self.cut, {})

    def ids(self, word: str) -> bytes:
        found = self.model.tokenize(word if word.isascii() and word.isalnum() else word.translate(self.letters))
        return array("I", [t.id for t in found]).tobytes() if sys.byteorder == "little" else np.array([t.id for t in found], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() cuts there, the vocabulary doesn't
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        raw = b"".join(map(self.words.__getitem__, text.lower().split()))
        if self.words.size > self.cache_bytes // 2:
            full, self.words = self.words, _Words(self.ids, self.cut, self.words)
            full.old = {}
        return raw


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then id 1; null and empty texts are just that.  Only documents
    longer than ``capacity`` are cut.  Every executor reads the vocabulary from the same path.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Batches) -> Batches:
        encode = encoder(tokenizer_path)
        try:
            for batch in batches:
                at, rows, ids = [], [], []
                for i, text in enumerate(batch.column(1)):
                    raw = encode(text.as_py() or "") + end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        at.append(i)
                        rows.append((k, a // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64()))]
                columns += [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
                names = ["doc_id", *(n for n, _ in fields)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            encode.forget()

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)


def plan(
    histogram: dict[int, int],
    capacity: int = 4096,
    max_docs: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> np.ndarray:
    """The ranges of the packing: rows (length, first number, per sequence, first sequence, sequences, offset).

    rule "norm": the least weighted norm of the residual left after placement, capacities scaled to 1;
    rule "dot": the greatest weighted dot product of the item and the residual.
    """
    max_docs, max_attention = max_docs or capacity, max_attention or capacity * capacity
    scale = np.array(weights) / np.array([capacity, max_docs, max_attention], float)
    # Open groups of like sequences: residual tokens, documents, attention; first sequence; how many.
    groups, used, ranges, next_sequence = np.zeros((1024, 5), np.int64), 0, [], 0

    def add(row: tuple) -> None:
        nonlocal groups, used
        if row[4] <= 0 or row[0] <= 0 or row[1] <= 0:
            return
        if used == len(groups):
            live = groups[groups[:, 4] > 0]
            groups = np.zeros((max(1024, 2 * len(live)), 5), np.int64)
            used = len(live)
            groups[:used] = live
        groups[used] = row
        used += 1

    for length in sorted(histogram, reverse=True):
        count, number, cost = histogram[length], 0, length * length
        if length > capacity or cost > max_attention:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        item = np.array([length, 1, cost])
        while count:
            g = groups[:used]
            fits = np.flatnonzero((g[:, 4] > 0) & (g[:, 0] >= length) & (g[:, 1] >= 1) & (g[:, 2] >= cost))
            if len(fits):
                rest = g[fits, :3]
                score = -np.square((rest - item) * scale).sum(1) if rule == "norm" else (rest * scale * item * scale).sum(1)
                best = fits[int(np.argmax(score))]
                tokens, docs, attention, first, many = groups[best].tolist()
                groups[best, 4] = 0
            else:
                tokens, docs, attention, first = capacity, max_docs, max_attention, next_sequence
                many = None
            each = min(tokens // length, docs, attention // cost)
            whole, rest_count = divmod(count, each)
            if many is None:
                many = whole + bool(rest_count)
                next_sequence += many
            full = min(whole, many)
            offset = capacity - tokens
            if full:
                ranges.append((length, number, each, first, full, offset))
                add((tokens - each * length, docs - each, attention - each * cost, first, full))
                number, count, first, many = number + full * each, count - full * each, first + full, many - full
            if many and 0 < count < each:
                ranges.append((length, number, count, first, 1, offset))
                add((tokens - count * length, docs - count, attention - count * cost, first, 1))
                number, count, first, many = number + count, 0, first + 1, many - 1
            add((tokens, docs, attention, first, many))
    return np.array(ranges, np.int64).reshape(-1, 6)


def numbered(items: DataFrame, most: int) -> DataFrame:
    """``items`` (row_id, length, ...) with number: 0, 1, ... among the rows of a length, at most ``most``."""
    buckets = max(LEAST_BUCKETS, -(-most // BUCKET_ROWS))
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id")) - 1
    return bucketed.withColumn("own", own).join(offsets, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    max_docs: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    with_ids: bool = False,
    label: str = "packing",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Without limits on documents and attention cost these can't bind, and tokens alone decide.
    Rows with null ids and repeated rows are packed once each, under the id they have; null and empty
    texts are one token.  An empty table gives an empty result, and other columns are not read.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids)
    cut = written(cut.withColumn("row_id", F.monotonically_increasing_id()), label)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    ranges = plan(histogram, capacity, max_docs, max_attention, rule)
    shared = docs.sparkSession.sparkContext.broadcast(ranges)  # rows follow the lengths, not the documents
    columns = [c for c in cut.columns if c != "row_id"]

    def place(batches: Batches) -> Batches:
        r = shared.value
        order = np.lexsort((r[:, 1], r[:, 0]))
        r = r[order]
        keys = (r[:, 0] << 44) | r[:, 1]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) | number, side="right") - 1
            _, first, each, sequence, _, offset = r[at].T
            k = number - first
            out = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            out += [pa.array(sequence + k // each, pa.int64()), pa.array(offset + (k % each) * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "row_id")
    return numbered(cut, max(histogram.values(), default=0)).select(*columns, "number").mapInArrow(place, f"{types}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed training rows of :func:`pack` with_ids: sequence_id, ids, lengths (for attention masks)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` tokens
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))
