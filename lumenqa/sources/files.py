"""JSON lines, JSON documents, the source registry, snapshots and the embedding cache."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser
from pathlib import Path, PurePosixPath
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning

# The fields of a registered source.
SOURCE_FIELDS = ("doc_id", "title", "source_type", "source_url", "include", "metadata_url", "topic", "reason")
SOURCES = "doc_id string, title string, source_type string, source_url string, include boolean, metadata_url string, topic string, reason string, extra map<string,string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, bad ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, keys sorted, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(row: dict[str, Any], path: str, ascii_only: bool = False) -> None:
    """One small report, indented, keys sorted."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, sort_keys=True, ensure_ascii=ascii_only, default=str)
        f.write("\n")


def load_sources(spark: SparkSession, entries: list[dict[str, Any]]) -> DataFrame:
    """The registry's entries (as parsed from YAML): known fields, and the rest as text in ``extra``.

    A missing ``include`` is true; an explicit null excludes.
    """
    rows = [tuple({"include": True, **e}.get(f) for f in SOURCE_FIELDS) + ({k: str(v) for k, v in e.items() if k not in SOURCE_FIELDS},) for e in entries]
    return spark.createDataFrame(rows, SOURCES)


def parse_registry(path: str) -> list[dict[str, Any]]:
    """The list under ``sources`` of a YAML file; needs the optional YAML package."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading a YAML registry needs the yaml package") from error
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    return found["sources"] if isinstance(found, dict) else found


def included(sources: DataFrame) -> DataFrame:
    return sources.filter("include")


def extension(source_type: Column) -> Column:
    return F.when(source_type == "pdf", ".pdf").when(source_type == "html", ".html").otherwise(F.raise_error(F.concat(F.lit("unsupported source type: "), F.coalesce(source_type, F.lit("null")))))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_path, content, sha256) of the frozen files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("snapshot_path"), "content", F.sha2("content", 256).alias("sha256"))


def utc_stamp(moment: Column | None = None) -> Column:
    """Second resolution; the session's time zone must be UTC."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def keep_fetched_at(new: DataFrame, old: DataFrame) -> DataFrame:
    """The earlier fetch time of a known document, else now."""
    known = old.select("doc_id", F.col("fetched_at").alias("__before"))
    return new.join(known, "doc_id", "left").withColumn("fetched_at", F.coalesce("__before", utc_stamp())).drop("__before")


# Elements whose text is kept, those passed over, and those without content.
KEPT_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "td", "th")
DROPPED_TAGS = ("script", "style", "noscript", "svg", "form", "nav", "header", "footer", "aside")
EMPTY_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Page(HTMLParser):
    """A tree of (tag, children) from forgiving parsing; text children are strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: tuple[str, list] = ("", [])
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = (tag, [])
        self.open[-1][1].append(node)
        if tag not in EMPTY_TAGS:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)


def _walk(node: tuple[str, list]) -> Iterator[Any]:
    """What is inside a node, in order, but for dropped elements: nodes and strings.  Pages may nest deeply, so nothing recurses."""
    waiting = [iter(node[1])]
    while waiting:
        child = next(waiting[-1], None)
        if child is None:
            waiting.pop()
        elif isinstance(child, str):
            yield child
        elif child[0] not in DROPPED_TAGS:
            yield child
            waiting.append(iter(child[1]))


def _strings(node: tuple[str, list]) -> Iterator[str]:
    return filter(None, (x.strip() for x in _walk(node) if isinstance(x, str)))


def page_text(page: str) -> str:
    """Headings, paragraphs, list items and cells of the main element, in document order.

    A kept element inside another is written both alone and inside it.
    """
    parser = _Page()
    parser.feed(page)
    parser.close()
    elements = [n for n in _walk(parser.root) if not isinstance(n, str)]
    root = next((n for tag in ("main", "article", "body") for n in elements if n[0] == tag), parser.root)
    out = []
    for node in _walk(root):
        if not isinstance(node, str) and node[0] in KEPT_TAGS and (text := " ".join(_strings(node))):
            out.append(f"\n{text}\n" if node[0][0] == "h" else f"- {text}" if node[0] == "li" else text)
    return "\n".join(out or _strings(root))


#: Pages that a worker holds as Python values at once.
PAGES_AT_ONCE = 256


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): extracted and cleaned text of web pages."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                texts = [page_text(h.as_py() or "") for h in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "raw"])
        pa.default_memory_pool().release_unused()  # the worker outlives its task

    raw = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {id_type}, raw string")
    return raw.select("page_id", cleaning.clean_html_text(F.col("raw")).alias("text"))


def extract_pdf(files: DataFrame, furniture: cleaning.Furniture = cleaning.FURNITURE) -> DataFrame:
    """(snapshot_path, text) of paged documents; needs the optional PDF package on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for f in frames:
            texts = []
            for content in f["content"]:
                found = [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                texts.append("\n\n".join(f"[Page {i}]\n{t}" for i, t in found if t.strip()))
            yield pd.DataFrame({"snapshot_path": f["snapshot_path"], "raw": texts})

    raw = files.select("snapshot_path", "content").mapInPandas(run, "snapshot_path string, raw string")
    return raw.select("snapshot_path", cleaning.clean_pdf_text(F.col("raw"), furniture).alias("text"))


MANIFEST = "doc_id string, title string, source_type string, source_url string, snapshot_path string, sha256 string, fetched_at string, metadata_url string, topic string, reason string, extra map<string,string>"


def download(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as reply:
        return reply.read()


def freeze_sources(spark: SparkSession, sources: DataFrame, raw_dir: str, refresh: bool = False, fetch: Callable[[str], bytes] = download) -> DataFrame:
    """The snapshot manifest of the included sources: raw_dir/<doc_id>/source.<type> and its metadata.json.

    A frozen file is used again unless ``refresh``; its earlier fetch time stays.  The registry is a
    hand-written list, so this runs on the driver.
    """
    rows = []
    for source in included(sources).withColumn("ending", extension(F.col("source_type"))).collect():
        folder = Path(raw_dir) / source["doc_id"]
        folder.mkdir(parents=True, exist_ok=True)
        path, about = folder / f"source{source['ending']}", folder / "metadata.json"
        fetched_at = None
        if refresh or not path.exists():
            path.write_bytes(fetch(source["source_url"]))
        elif about.exists():
            fetched_at = json.loads(about.read_text(encoding="utf-8")).get("fetched_at")
        fetched_at = fetched_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
        row = {c: source[c] for c in ("doc_id", "title", "source_type", "source_url", "metadata_url", "topic", "reason", "extra")}
        row |= {"snapshot_path": str(path), "sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "fetched_at": fetched_at}
        write_json(row, str(about))
        rows.append(tuple(row[f.split()[0]] for f in MANIFEST.split(", ")))
    return spark.createDataFrame(rows, MANIFEST)


def build_documents(manifest: DataFrame, furniture: cleaning.Furniture = cleaning.FURNITURE) -> DataFrame:
    """The manifest with the ``text`` of each snapshot, extracted by its type."""
    spark = manifest.sparkSession
    paths = [r[0] for r in manifest.select("snapshot_path").collect()]  # one per registered source
    if not paths:
        return manifest.withColumn("text", F.lit("")).limit(0)
    content = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("__path"), "content")
    at = F.regexp_replace("snapshot_path", "^file:/*", "/")
    found = manifest.join(content, at == F.col("__path"))
    html = found.filter("source_type = 'html'").withColumn("html", F.decode("content", "UTF-8"))
    texts = extract_pages(html, "snapshot_path").withColumnRenamed("page_id", "snapshot_path")
    if not manifest.filter("source_type = 'pdf'").isEmpty():
        texts = texts.unionByName(extract_pdf(found.filter("source_type = 'pdf'"), furniture))
    return manifest.join(texts, "snapshot_path").select(*manifest.columns, "text")


def review_files(results_dir: str) -> list[str]:
    """The review templates of a folder, by name."""
    return sorted(str(p) for p in Path(results_dir).glob("generations_*_review_template.jsonl"))


def reviewed_name(path: str) -> str:
    """The metrics file of a review template; other names are an error."""
    m = re.fullmatch(r"generations_(.+)_review_template", PurePosixPath(path).stem)
    if not m:
        raise ValueError(f"not a review template: {path}")
    return str(PurePosixPath(path).with_name(f"generations_{m[1]}_reviewed_eval.json"))


def cached_embeddings(spark: SparkSession, path: str, chunks: DataFrame, model: str, corpus_sha: str) -> DataFrame | None:
    """The cached vectors if model, corpus hash and the ordered chunk ids all agree, else None."""
    try:
        cache = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    own = cache.filter((F.col("model") == model) & (F.col("corpus_sha") == corpus_sha))
    at = own.select("position", "chunk_id")
    wanted = chunks.select("position", "chunk_id")
    return None if at.exceptAll(wanted).union(wanted.exceptAll(at)).limit(1).count() else own


def cache_embeddings(vectors: DataFrame, path: str, model: str, corpus_sha: str) -> None:
    """``vectors``: position, chunk_id, vector."""
    vectors.withColumns({"model": F.lit(model), "corpus_sha": F.lit(corpus_sha)}).write.mode("overwrite").partitionBy("model", "corpus_sha").parquet(path)


def corpus_sha(chunks: DataFrame) -> str:
    """A hash of the ordered ids and texts, by hash of row hashes."""
    rows = chunks.select(F.sha2(F.concat_ws("\x1f", F.col("position").cast("string"), "chunk_id", "text"), 256).alias("h"))
    mark = rows.agg(F.count(F.lit(1)), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")), F.sum(F.conv(F.substring("h", 17, 8), 16, 10).cast("long"))).first()
    return "-".join(map(str, mark))
