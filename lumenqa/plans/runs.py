"""Whole runs from files to files: ingest, chunk, search, validate, evaluate, compare, generate, review.

A run composes operators over tables read from JSON lines and writes small reports as JSON and
tables as folders of JSON lines.  Only reports are gathered on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import chunking, evaluation, generation, metrics, retrieval, validation
from ..sources import files

CHUNKS = "chunk_id string, doc_id string, title string, section string, source_url string, text string, word_count int, chunk_index int, source_type string, metadata_url string, topic string"
QUESTIONS = (
    "question_id string, question string, answerable boolean, topic string, question_type string, difficulty string, requires_multi_chunk boolean, requires_multi_doc boolean, "
    "gold_doc_ids array<string>, gold_chunk_ids array<string>, gold_answer_short string, evidence array<struct<chunk_id:string,doc_id:string,quote:string>>, "
    "qrels array<struct<chunk_id:string,doc_id:string,relevance:int>>, unanswerable_type string, negative_rationale string, near_miss_doc_ids array<string>, notes string"
)
PREDICTIONS = (
    "question_id string, question string, answerable boolean, topic string, question_type string, difficulty string, gold_chunk_ids array<string>, gold_doc_ids array<string>, near_miss_doc_ids array<string>, "
    "qrel_relevances array<int>, retrieved array<struct<rank:int,chunk_id:string,doc_id:string,section:string,score:double,relevance:int,is_gold_doc:boolean,is_near_miss_doc:boolean,text_preview:string>>"
)
GENERATIONS = (
    "question_id string, system string, question string, answer string, abstained boolean, abstention_reason string, citations array<string>, "
    "retrieved_chunks array<struct<rank:int,chunk_id:string,doc_id:string,section:string,score:double,title:string,chunk_index:int,text_preview:string>>, model string, temperature double, dry_run boolean"
)
REVIEWS = (
    "question_id string, system string, question string, answerable boolean, gold_answer_short string, gold_chunk_ids array<string>, model_answer string, abstained boolean, abstention_reason string, citations array<string>, retrieved_chunk_ids array<string>, "
    "manual_correct boolean, manual_citation_supported boolean, manual_hallucinated boolean, review_abstention_correct boolean, review_hallucination_severity string, manual_notes string"
)
#: Names of the summary's parts in a report.
_PARTS = {"answerability": "answerability", "topic": "topics", "question_type": "question_types", "difficulty": "difficulties", "gold_doc": "gold_docs"}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return files.read_jsonl(spark, path, CHUNKS)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return files.read_jsonl(spark, path, QUESTIONS)


def ingest(spark: SparkSession, registry: str, raw_dir: str, processed_dir: str, refresh: bool = False, fetch: Callable[[str], bytes] = files.download, furniture: cleaning.Furniture = cleaning.FURNITURE) -> DataFrame:
    """Freezes the included sources and writes snapshot_manifest.jsonl and documents.jsonl."""
    manifest = files.freeze_sources(spark, files.load_sources(spark, files.parse_registry(registry)), raw_dir, refresh, fetch)
    documents = files.build_documents(manifest, furniture)
    files.write_jsonl(manifest, f"{processed_dir}/snapshot_manifest.jsonl")
    files.write_jsonl(documents, f"{processed_dir}/documents.jsonl")
    return documents


def chunk(spark: SparkSession, documents: str, output: str, target: int = chunking.TARGET_WORDS, limit: int = chunking.MAX_WORDS, overlap: int = chunking.OVERLAP_WORDS) -> DataFrame:
    docs = files.read_jsonl(spark, documents, files.MANIFEST + ", text string")
    files.write_jsonl(chunking.chunk_records(docs, target, limit, overlap), output)
    return read_chunks(spark, output)


def search(spark: SparkSession, query: str, chunks: str, top_k: int = 5, retriever: str = "bm25", **options: Any) -> DataFrame:
    """rank, score, chunk_id, title, section, text_preview of one query."""
    found = read_chunks(spark, chunks)
    asked = spark.createDataFrame([("query", query)], "question_id string, question string")
    ranked = retrieval.build_retriever(retriever, found, **options).search(asked, top_k)
    return retrieval.with_text(ranked, found).select("rank", "score", "chunk_id", "title", "section", "text_preview").orderBy("rank")


def validate(spark: SparkSession, questions: str, chunks: str) -> tuple[DataFrame, dict[str, Any]]:
    """All findings and the summary; rows that lack a key count for the duplicate rules only."""
    lines = spark.read.text(questions).filter("trim(value) <> ''").withColumn("row", F.monotonically_increasing_id())
    rows = lines.select("row", "value", F.from_json("value", QUESTIONS, {"mode": "PERMISSIVE"}).alias("q")).select("row", "value", "q.*")
    complete = F.size(F.array_except(F.array(*map(F.lit, validation.REQUIRED)), F.json_object_keys("value"))) == 0
    whole, known = rows.filter(complete), read_chunks(spark, chunks)
    found = validation.row_rules(whole).unionByName(validation.reference_rules(whole, known)).unionByName(validation.not_boolean(lines.filter(complete)))
    found = found.unionByName(validation.missing_fields(lines)).unionByName(validation.duplicate_rules(rows))
    report: dict[str, Any] = {"num_questions": rows.count(), **{p: {} for p in _PARTS.values()}}
    for r in validation.summary(whole).collect():  # a benchmark's few facets and gold documents
        report[_PARTS[r["scope"]]][r["value"]] = r["n"]
    return found, report


def _qrels(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.posexplode("qrels").alias("pos", "q")).select("question_id", "pos", "q.*")


def _judged(questions: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    near = questions.select("question_id", F.explode("near_miss_doc_ids").alias("doc_id"))
    return metrics.judge(ranked, qrels, near, questions.select("question_id", F.explode("gold_doc_ids").alias("doc_id")))


def _nested(rows: DataFrame, keys: list[str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for r in rows.collect():  # metrics of a few slices
        at = out
        for k in keys:
            at = at.setdefault(r[k], {})
        at[r["metric"]] = r["value"]
    return out


def evaluate_retrieval(spark: SparkSession, questions: str, chunks: str, output: str, predictions: str, retriever: str = "bm25", top_k: int = 10, **options: Any) -> dict[str, Any]:
    """The metrics report and the prediction rows of one search; an invalid benchmark is an error."""
    findings, summary = validate(spark, questions, chunks)
    validation.gate(findings)
    asked, found = read_questions(spark, questions), read_chunks(spark, chunks)
    search = retrieval.build_retriever(retriever, found, **options)
    qrels = _qrels(asked)
    judged = _judged(asked, search.search(asked, top_k).select("question_id", "rank", "chunk_id", "doc_id", "score"), qrels)
    rows = metrics.per_question(asked, judged, qrels, top_k)
    own = _nested(metrics.answerable_metrics(rows, top_k), ["slice", "group"])
    report = {
        "benchmark": summary, "retriever": search.describe() | {"top_k": top_k, "k_values": metrics.k_values(top_k), "query_expansion": search.expand},
        "answerable": own.get("all", {}).get("all", {}), "unanswerable": _nested(metrics.unanswerable_metrics(rows, top_k), []),
        **{f"by_{s}": own.get(s, {}) for s in ("topic", "question_type", "difficulty")},
    }
    files.write_json(report, output)
    shown = retrieval.with_text(judged, found)
    item = F.struct("rank", "chunk_id", "doc_id", "section", "score", "relevance", "is_gold_doc", "is_near_miss_doc", "text_preview")
    nested = shown.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("retrieved"))  # top_k at most
    kept = [c.split()[0] for c in PREDICTIONS.split(", ")][:9]
    out = asked.join(nested, "question_id", "left").select(*kept, F.col("qrels.relevance").alias("qrel_relevances"), F.coalesce("retrieved", F.array().cast(nested.schema["retrieved"].dataType)).alias("retrieved"))
    files.write_jsonl(out, predictions)
    return report


def compare(spark: SparkSession, left: str, right: str, left_name: str, right_name: str, output: str) -> dict[str, Any]:
    """Two sets of predictions, question by question and by slice; differing question sets are an error."""
    sides = []
    for path in (left, right):
        rows = files.read_jsonl(spark, path, PREDICTIONS)
        ranked = rows.select("question_id", F.explode("retrieved").alias("r")).select("question_id", "r.*")
        grades = ranked.select("question_id", "chunk_id", "doc_id", "relevance")
        sides.append((metrics.per_question(rows.drop("retrieved"), ranked, grades), ranked))
    both = metrics.matched(sides[0][0], sides[1][0])
    name = {"left_only": f"{left_name}_only", "right_only": f"{right_name}_only"}
    overall: dict[str, Any] = {}
    for r in metrics.contingency(both).collect():
        part = overall.setdefault(f"k={r['k']}", {})
        part[name.get(r["bucket"], r["bucket"])] = {"count": r["n"], "question_ids": r["question_ids"]}
    grouped: dict[str, Any] = {}
    for r in metrics.contingency_by(both).collect():
        grouped.setdefault(r["slice"], {}).setdefault(r["group"], {})[f"k={r['k']}"] = {name.get(b, b): r[b] for b in metrics.BUCKETS}
    detail = [r.asDict() for r in metrics.comparison_detail(both, sides[0][1], sides[1][1]).orderBy("question_id").collect()]  # a benchmark's questions
    report = {"left": left_name, "right": right_name, "overall": overall, "grouped": grouped, "per_question": detail}
    files.write_json(report, output)
    return report


def generate(
    spark: SparkSession, questions: str, chunks: str, system: str, output: str, generator: generation.Generator | None = None, top_k: int = 5, max_iterations: int = 5,
    model: str = "none", limit: int | None = None, question_ids: list[str] | None = None, **options: Any,
) -> DataFrame:
    """The generations of one system; without a generator a dry run, whose iterative system searches once."""
    validation.gate(validate(spark, questions, chunks)[0])
    asked, found = generation.select_questions(read_questions(spark, questions), question_ids, limit), read_chunks(spark, chunks)
    search = retrieval.system_retriever(system, found, **options)
    trace: DataFrame | None = None
    ranked = search.search(asked, top_k) if search else None
    if generator is None:
        answers = generation.dry_run(asked)
    elif system == "iterkey_rag":
        trace = generation.iterate_keywords(asked, found, generation.model_keywords(generator), top_k, max_iterations)
        answers = generation.final_answers(asked, trace)
        last = trace.groupBy("question_id").agg(F.max_by("expanded_query", "iteration").alias("question"))
        ranked = retrieval.bm25_search(last, found, top_k)
    elif ranked is None:
        instructions, text = generation.open_prompt()
        answers = generation.generate(asked.select("question_id", instructions.alias("instructions"), text.alias("input")), generator)
    else:
        answers = generation.generate(generation.evidence_prompts(asked, ranked, found), generator)
    rows = generation.generation_rows(answers, asked, ranked, found, system, model, generator.temperature if generator else 0.0, dry=generator is None)
    if trace is not None:
        steps = F.sort_array(F.collect_list(F.struct("iteration", "keywords", "expanded_query", "retrieved_chunk_ids", "answer", "abstained", "citations", "is_supported")))
        rows = rows.join(trace.groupBy("question_id").agg(steps.alias("iterkey_trace")), "question_id", "left")  # max_iterations at most
    files.write_jsonl(rows, output)  # calls are made once, here
    return files.read_jsonl(spark, output, GENERATIONS)


def evaluate_generations(spark: SparkSession, generations: str, questions: str, chunks: str, output: str, review_output: str) -> dict[str, Any]:
    """The heuristic metrics of each system and the rows for its reviewers."""
    made = files.read_jsonl(spark, generations, GENERATIONS).withColumn("retrieved_chunk_ids", F.col("retrieved_chunks.chunk_id"))
    judged = F.transform(F.filter("qrels", lambda q: q["relevance"] == metrics.RELEVANT), lambda q: q["chunk_id"])
    asked = read_questions(spark, questions)
    gold = asked.withColumn("gold_chunk_ids", F.array_union("gold_chunk_ids", judged))
    rows = evaluation.analyse(made, gold, read_chunks(spark, chunks))
    report = {r["system"]: r.asDict() for r in evaluation.heuristic_metrics(rows).collect()}  # one row a system
    files.write_json(report, output)
    flags = F.struct(*[c for c in rows.columns if c not in ("question_id", "system", "answerable", "abstained")]).alias("heuristics")
    shown = made.select("question_id", "system", F.col("answer").alias("model_answer"), "abstained", "abstention_reason", "citations", "retrieved_chunk_ids")
    review = evaluation.review_template(shown, asked).join(asked.select("question_id", "gold_answer_short"), "question_id")
    files.write_jsonl(review.join(rows.select("question_id", "system", flags), ["question_id", "system"]), review_output)
    return report


def evaluate_reviews(spark: SparkSession, combined_output: str, templates: list[str] | None = None, results_dir: str = "data/results") -> dict[str, Any]:
    """One report per review template and one for all; a template holds one system, the last of a system wins."""
    templates = templates or files.review_files(results_dir)
    if not templates:
        raise ValueError("there are no review templates")
    combined: dict[str, Any] = {}
    for path in templates:
        rows = files.read_jsonl(spark, path, REVIEWS)
        got = [r.asDict() for r in evaluation.reviewed_metrics(rows).collect()]
        if len(got) > 1:
            raise ValueError(f"a review template of several systems: {path}")
        validation.label_gate(rows)
        own = got[0] | {"flagged_rows": [r.asDict() for r in evaluation.flagged_rows(rows).orderBy("question_id").collect()]}
        files.write_json(own, files.reviewed_name(path), ascii_only=True)
        combined[own["system"]] = own
    files.write_json(combined, combined_output, ascii_only=True)
    return combined


def dashboard(spark: SparkSession, questions: str, metrics_path: str, output: str, templates: list[str] | None = None, results_dir: str = "data/results") -> dict[str, Any]:
    """One JSON document for the explorer: questions, metrics by system, reviews by system.

    A benchmark's questions and their reviews are small; the tables behind it are
    :func:`evaluation.compact_questions`, :func:`evaluation.compact_reviews` and :func:`evaluation.bundle`.
    """
    rows: dict[str, list[dict[str, Any]]] = {system: [] for system in generation.SYSTEMS}
    for path in templates or files.review_files(results_dir):
        for r in evaluation.compact_reviews(files.read_jsonl(spark, path, REVIEWS)).collect():
            rows.setdefault(r["system"], []).append(r.asDict(recursive=True))
    asked = [r.asDict(recursive=True) for r in evaluation.compact_questions(read_questions(spark, questions)).collect()]
    with open(metrics_path, encoding="utf-8") as f:
        known = json.load(f)
    payload = {"generated_at": "reviewed-results-snapshot", "questions": asked, "metrics": known, "reviews": rows}
    files.write_json(payload, output)
    return payload
