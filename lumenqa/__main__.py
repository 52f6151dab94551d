"""Command line: ``python -m lumenqa <run> ...``; each run is a function of :mod:`lumenqa.plans.runs`."""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from .functions import cleaning
from .operators import generation, retrieval
from .plans import runs


def named(spec: str | None, default: Any = None) -> Any:
    """The object at ``module:name``."""
    if not spec:
        return default
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenqa")
    runs_of = top.add_subparsers(dest="run", required=True)

    def add(name: str, *positional: str, **options: Any) -> None:
        p = runs_of.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for flag, default in options.items():
            kind: dict[str, Any] = {"default": default}
            if default is False:
                kind = {"action": "store_true"}
            elif default is list:
                kind = {"action": "append"}
            elif default is not None:
                kind["type"] = type(default)
            p.add_argument("--" + flag.replace("_", "-"), **kind)

    chunks, search = "data/processed/chunks.jsonl", {"candidate_k": 20, "dense_model": None, "reranker_model": None}
    add("ingest", "sources", raw_dir="data/raw", processed_dir="data/processed", refresh=False, publisher=None, domain=None)
    add("chunk", "documents", output=chunks, target_words=320, max_words=380, overlap_words=50)
    add("search", "query", chunks=chunks, top_k=5, expand=False, retriever="bm25", **search)
    add("validate", "questions", chunks=chunks)
    add("evaluate", "questions", chunks=chunks, retriever="bm25", output=None, predictions=None, top_k=10, expand=False, **search)
    add("compare", left=None, right=None, left_name="left", right_name="right", output="data/results/retrieval_comparison.json")
    add("generate", "questions", chunks=chunks, system="bm25_rag", output=None, top_k=5, max_iterations=5, model=None, temperature=0.0, limit=-1, question_id=list, dry_run=False, key_variable=None, strict=False, **search)
    add("score", "generations", questions="data/benchmark/questions.jsonl", chunks=chunks, output=None, review_output=None)
    add("review", results_dir="data/results", template=list, combined_output="data/results/reviewed_generation_metrics.json")
    add("dashboard", "questions", metrics="data/results/reviewed_generation_metrics.json", results_dir="data/results", template=list, output="data/results/dashboard-data.json")
    return top


def main(argv: list[str] | None = None, spark: Any = None) -> int:
    """0, or 1 if a benchmark has errors.

    Models are given as ``module:name``; with ``--strict`` a language model gets the strict request as
    a fourth argument, and with ``--key-variable`` a run needs that variable of the environment.
    """
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lumenqa").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = {}
    if hasattr(a, "candidate_k"):
        options = {"candidate_k": a.candidate_k, "encoder": named(a.dense_model, retrieval.hashed_encoder), "scorer": named(a.reranker_model, retrieval.overlap_scorer)}
    if a.run == "ingest":
        furniture = cleaning.FURNITURE.of(a.publisher, a.domain or "") if a.publisher else cleaning.FURNITURE
        runs.ingest(spark, a.sources, a.raw_dir, a.processed_dir, a.refresh, furniture=furniture)
    elif a.run == "chunk":
        runs.chunk(spark, a.documents, a.output, a.target_words, a.max_words, a.overlap_words)
    elif a.run == "search":
        runs.search(spark, a.query, a.chunks, a.top_k, a.retriever, expand=a.expand, **options).show(a.top_k, truncate=300)
    elif a.run == "validate":
        findings, summary = runs.validate(spark, a.questions, a.chunks)
        rows = findings.orderBy("severity", "question_id").collect()  # findings about one benchmark
        for r in rows:
            print(f"{r['severity'].upper()}: {r['question_id']}: {r['message']}")
        print(summary)
        return int(any(r["severity"] == "error" for r in rows))
    elif a.run == "evaluate":
        output = a.output or f"data/results/retrieval_{a.retriever}.json"
        runs.evaluate_retrieval(spark, a.questions, a.chunks, output, a.predictions or output.removesuffix(".json") + "_predictions.jsonl", a.retriever, a.top_k, expand=a.expand, **options)
    elif a.run == "compare":
        runs.compare(spark, a.left, a.right, a.left_name, a.right_name, a.output)
    elif a.run == "generate":
        if not (a.model or a.dry_run):
            raise SystemExit("a model (module:name) or --dry-run is needed")
        if a.key_variable and not a.dry_run:
            generation.require_key(a.key_variable)
        generator = None if a.dry_run else generation.Generator(named(a.model), a.temperature, model=a.model, schemas=a.strict)
        runs.generate(
            spark, a.questions, a.chunks, a.system, a.output or f"data/results/generations_{a.system}.jsonl", generator, a.top_k, a.max_iterations,
            a.model or "none", a.limit if a.limit >= 0 else None, a.question_id, **options,
        )
    elif a.run == "score":
        stem = a.generations.rstrip("/").rpartition("/")[2].removesuffix(".jsonl")
        runs.evaluate_generations(spark, a.generations, a.questions, a.chunks, a.output or f"data/results/{stem}_eval.json", a.review_output or f"data/results/{stem}_review_template.jsonl")
    elif a.run == "dashboard":
        runs.dashboard(spark, a.questions, a.metrics, a.output, a.template, a.results_dir)
    else:
        runs.evaluate_reviews(spark, a.combined_output, a.template, a.results_dir)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
