"""Prompts, generation with an injectable model, and the iterative keyword loop."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import scratch
from ..sources.files import utc_stamp
from .retrieval import bm25_search, with_columns_of, with_text

# The generation systems, and what a structured answer must look like.
SYSTEMS = ("non_rag", "bm25_rag", "dense_rag", "bm25_rerank_rag", "dense_rerank_rag", "iterkey_rag")
ANSWER = "answer string, abstained boolean, abstention_reason string, citations array<string>"


def strict_schema(**properties: dict[str, Any]) -> dict[str, Any]:
    """A JSON schema of an object with exactly these properties."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


ANSWER_SCHEMA = strict_schema(
    answer={"type": "string"}, abstained={"type": "boolean"}, abstention_reason={"type": ["string", "null"]}, citations={"type": "array", "items": {"type": "string"}}
)
KEYWORDS_SCHEMA = strict_schema(keywords={"type": "array", "items": {"type": "string"}})
SUPPORT_SCHEMA = strict_schema(supported={"type": "boolean"})
#: Instructions; ``{domain}`` is what the collection is about.
OPEN_RULES = "Answer the question about {domain} from general knowledge. No passages are given: cite nothing, and abstain only if no answer is possible. Return structured JSON only."
EVIDENCE_RULES = "Answer the question about {domain} from the evidence passages only. Cite the exact chunk_id of every passage that supports the answer. If the passages don't hold the answer, abstain. Return structured JSON only."


def open_prompt(domain: str = "the collection") -> tuple[Column, Column]:
    """(instructions, input) without evidence."""
    return F.lit(OPEN_RULES.format(domain=domain)), F.concat(F.lit("Question ID: "), F.col("question_id").cast("string"), F.lit("\nQuestion: "), F.col("question"))


def evidence_prompts(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, domain: str = "the collection") -> DataFrame:
    """question_id, instructions, input: evidence blocks in rank order; no results give an empty block list."""
    part = F.concat(F.lit("[chunk_id: "), F.col("chunk_id"), F.lit("]\ntitle: "), F.coalesce("title", F.lit("None")), F.lit("\nsection: "), F.coalesce("section", F.lit("None")), F.lit("\ntext:\n"), F.col("text"))
    rows = with_columns_of(chunks, ranked.select("question_id", "rank", "chunk_id"), "title", "section", "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    evidence = rows.groupBy("question_id").agg(F.array_join(parts, "\n").alias("evidence"))
    _, head = open_prompt(domain)
    text = F.concat(head, F.lit("\n\nEvidence chunks:\n"), F.coalesce("evidence", F.lit("")), F.lit("\n\nAnswer using only the evidence chunks above."))
    return questions.select("question_id", "question").join(evidence, "question_id", "left").select("question_id", F.lit(EVIDENCE_RULES.format(domain=domain)).alias("instructions"), text.alias("input"))


def select_questions(questions: DataFrame, ids: list[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """An id list beats a limit; unknown ids are an error.  A limit takes the first by ``order``, else as the rows come."""
    if ids:
        wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], "wanted string")
        key = F.col("question_id").cast("string") == F.col("wanted")
        unknown = wanted.join(questions, key, "left_anti").collect()
        if unknown:
            raise ValueError("unknown question ids: " + ", ".join(sorted(r[0] for r in unknown)))
        return questions.join(F.broadcast(wanted), key, "left_semi")  # a list given by hand
    if limit is None:
        return questions
    if order is None:  # the place of a row in its files
        return questions.withColumn("__place", F.monotonically_increasing_id()).orderBy("__place").limit(limit).drop("__place")
    return questions.orderBy(order).limit(limit)


def request(model: str, instructions: str, text: str, schema: dict[str, Any], name: str = "answer", temperature: float | None = None) -> dict[str, Any]:
    """The arguments of a structured call: the reply must be JSON by a strict schema; no temperature is sent if there is none."""
    reply = {"type": "json_schema", "name": name, "strict": True, "schema": schema}
    out = {"model": model, "instructions": instructions, "input": text, "text": {"format": reply}}
    return out if temperature is None else out | {"temperature": temperature}


#: JSON types by their names in a schema.
_JSON_TYPES = {"string": str, "boolean": bool, "array": list, "null": type(None), "object": dict}


def parse_reply(text: str, schema: dict[str, Any] | None = None) -> dict[str, Any]:
    """The object of a reply; what isn't JSON, or not by the schema, is an error."""
    found = json.loads(text)
    if schema is None:
        return found
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    lost, more = set(schema["required"]) - set(found), set(found) - set(schema["properties"])
    if lost or more:
        raise ValueError(f"the reply lacks {sorted(lost)} and has {sorted(more)} besides")
    for key, rule in schema["properties"].items():
        kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        items = rule.get("items", {}).get("type")
        value = found[key]
        if not any(isinstance(value, _JSON_TYPES[k]) for k in kinds) or (items and isinstance(value, list) and not all(isinstance(x, _JSON_TYPES[items]) for x in value)):
            raise ValueError(f"the reply's {key} is not of type {' or '.join(kinds)}")
    return found


def require_key(variable: str) -> str:
    """The key that a model call needs, from the environment; without one no run starts."""
    key = os.environ.get(variable, "").strip()
    if not key:
        raise RuntimeError(f"{variable} is not set: a run with a model needs its key")
    return key


@dataclass
class Generator:
    """A model behind a call (instructions, input, temperature) -> JSON text, with retries.

    With ``schemas`` the call gets the strict request as a fourth argument and its reply is checked.
    A request that fails because of its temperature is repeated without one; other failures wait 1, 2,
    ... seconds.
    """

    call: Callable[..., str]
    temperature: float = 0.0
    attempts: int = 3
    wait: Callable[[float], None] = field(default=time.sleep)
    model: str = "none"
    schemas: bool = False

    def __call__(self, instructions: str, text: str, schema: dict[str, Any] = ANSWER_SCHEMA, name: str = "answer") -> dict[str, Any]:
        temperature: float | None = self.temperature
        for attempt in range(self.attempts):
            try:
                if not self.schemas:
                    return parse_reply(self.call(instructions, text, temperature))
                return parse_reply(self.call(instructions, text, temperature, request(self.model, instructions, text, schema, name, temperature)), schema)
            except Exception as error:
                if attempt + 1 == self.attempts:
                    raise
                if temperature is not None and "temperature" in str(error):
                    temperature = None
                else:
                    self.wait(2.0**attempt)
        raise RuntimeError("no attempts")


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """question_id and the parsed answer.  Write the result before using it twice: calls cost and vary."""
    id_type = prompts.schema["question_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [generator(i, t) for i, t in zip(frame["instructions"], frame["input"], strict=True)]
            yield pd.DataFrame({"question_id": frame["question_id"], **{c: [o.get(c) for o in out] for c in ("answer", "abstained", "abstention_reason", "citations")}})

    return prompts.select("question_id", "instructions", "input").mapInPandas(run, f"question_id {id_type}, {ANSWER}")


def dry_run(questions: DataFrame) -> DataFrame:
    """The constant answer of a run without a model."""
    return questions.select("question_id", F.lit("").alias("answer"), F.lit(True).alias("abstained"), F.lit("dry_run").alias("abstention_reason"), F.array().cast("array<string>").alias("citations"))


def generation_rows(answers: DataFrame, questions: DataFrame, ranked: DataFrame | None, chunks: DataFrame, system: str, model: str = "none", temperature: float = 0.0, dry: bool = False) -> DataFrame:
    """The full record of a run: answers with their questions and retrieved chunks in rank order."""
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}; known: {', '.join(SYSTEMS)}")
    id_type = chunks.schema["doc_id"].dataType.simpleString()
    item = f"struct<rank:int,chunk_id:string,doc_id:{id_type},section:string,score:double,title:string,chunk_index:int,text_preview:string>"
    rows = answers.join(questions.select("question_id", "question"), "question_id")
    if ranked is None:
        rows = rows.withColumn("retrieved_chunks", F.array().cast(f"array<{item}>"))
    else:
        shown = with_text(ranked, chunks)
        entry = F.struct("rank", "chunk_id", "doc_id", "section", "score", "title", "chunk_index", "text_preview").cast(item)
        rows = rows.join(shown.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("retrieved_chunks")), "question_id", "left")
        rows = rows.withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast(f"array<{item}>")))
    version = {"non_rag": "non_rag_v1", "iterkey_rag": "iterkey_v1"}.get(system, "rag_v1")
    extra = {"prompt_version": F.lit(version), "created_at": utc_stamp(), "system": F.lit(system), "model": F.lit(model), "temperature": F.lit(float(temperature)), "dry_run": F.lit(dry)}
    return rows.withColumns(extra)


@dataclass
class KeywordModel:
    """The three calls of the loop, each given whole questions; any of them may call a language model.

    ``answer`` gets the retrieved ids in rank order and, with ``wants_evidence``, the prompt input of
    :func:`evidence_prompts` as a third argument.
    """

    keywords: Callable[[str, list[str]], list[str]]
    answer: Callable[..., dict[str, Any]]
    supported: Callable[[str, dict[str, Any]], bool]
    wants_evidence: bool = False


#: Instructions of the two helper calls of :func:`model_keywords`.
KEYWORD_RULES = "Give short search keywords for the question that are not among those already tried. Return JSON: {\"keywords\": [...]}."
SUPPORT_RULES = "Say whether the answer is fully supported by the passages it cites. Return JSON: {\"supported\": true or false}."


def model_keywords(generator: Generator) -> KeywordModel:
    """The loop's three calls made by one language model."""
    return KeywordModel(
        lambda q, tried: list(generator(KEYWORD_RULES, f"Question: {q}\nTried: {', '.join(tried)}", KEYWORDS_SCHEMA, "keywords").get("keywords") or []),
        lambda q, ids, evidence: generator(EVIDENCE_RULES.format(domain="the collection"), evidence),
        lambda q, a: not a.get("abstained") and bool(generator(SUPPORT_RULES, f"Question: {q}\nAnswer: {a.get('answer')}\nCited: {', '.join(a.get('citations') or [])}", SUPPORT_SCHEMA, "support").get("supported")),
        wants_evidence=True,
    )


def iterate_keywords(questions: DataFrame, chunks: DataFrame, model: KeywordModel, top_k: int = 5, max_iterations: int = 5, written: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keywords, expanded search, answer, check; questions leave the loop when supported.

    Returns the trace: question_id, iteration, keywords, expanded_query, retrieved_chunk_ids, answer,
    abstained, citations, is_supported.  Each round handles all open questions as one plan; ``written``
    fixes a round's result (model calls must not be repeated).
    """
    keep = written or (lambda df: scratch.written(df, "keywords"))  # a lost executor repeats no call
    open_rows = questions.select("question_id", "question", F.array().cast("array<string>").alias("previous"))
    trace: DataFrame | None = None
    ids = questions.schema["question_id"].dataType.simpleString()
    for iteration in range(1, max_iterations + 1):

        def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(keywords=[model.keywords(q, list(p)) for q, p in zip(f["question"], f["previous"], strict=True)])[["question_id", "question", "keywords"]]

        asked = open_rows.mapInPandas(expand, f"question_id {ids}, question string, keywords array<string>")
        asked = keep(asked.withColumn("keywords", tx.clean_keywords(F.col("keywords"))).withColumn("expanded_query", tx.expanded_query_text(F.col("question"), F.col("keywords"))))
        ranked = bm25_search(asked.select("question_id", F.col("expanded_query").alias("question")), chunks, top_k)
        found = ranked.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
        rows = asked.join(found, "question_id", "left").withColumn("retrieved_chunk_ids", F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")))

        if model.wants_evidence:
            rows = rows.join(evidence_prompts(asked, ranked, chunks).select("question_id", F.col("input").alias("evidence")), "question_id")
        else:
            rows = rows.withColumn("evidence", F.lit(""))

        def reply(frames: Iterator[pd.DataFrame], iteration: int = iteration) -> Iterator[pd.DataFrame]:
            for f in frames:
                texts = f.pop("evidence")
                extra = [(t,) if model.wants_evidence else () for t in texts]
                got = [model.answer(q, list(c), *e) for q, c, e in zip(f["question"], f["retrieved_chunk_ids"], extra, strict=True)]
                ok = [bool(model.supported(q, a)) for q, a in zip(f["question"], got, strict=True)]
                yield f.assign(iteration=iteration, is_supported=ok, **{k: [a.get(k) for a in got] for k in ("answer", "abstained", "citations")})

        schema = f"question_id {ids}, question string, keywords array<string>, expanded_query string, retrieved_chunk_ids array<string>, iteration int, is_supported boolean, answer string, abstained boolean, citations array<string>"
        done = keep(rows.select("question_id", "question", "keywords", "expanded_query", "retrieved_chunk_ids", "evidence").mapInPandas(reply, schema))
        trace = done if trace is None else trace.unionByName(done)
        open_rows = done.filter("not is_supported").select("question_id", "question", F.col("keywords").alias("previous"))
        if open_rows.isEmpty():
            break
    if trace is None:
        empty = "question_id " + ids + ", question string, keywords array<string>, expanded_query string, retrieved_chunk_ids array<string>, iteration int, is_supported boolean, answer string, abstained boolean, citations array<string>"
        return questions.sparkSession.createDataFrame([], empty)
    return trace


def final_answers(questions: DataFrame, trace: DataFrame) -> DataFrame:
    """The last answer if supported or abstaining, else an abstention that cites what was last retrieved."""
    last = trace.groupBy("question_id").agg(F.max_by(F.struct("answer", "abstained", "citations", "retrieved_chunk_ids", "is_supported"), "iteration").alias("l"), F.max("iteration").alias("n"))
    rows = questions.select("question_id").join(last, "question_id", "left")
    own = F.coalesce(F.col("l.is_supported") | F.col("l.abstained"), F.lit(False))
    reason = F.concat(F.lit("No support was confirmed after "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" iterations."))
    none = F.array().cast("array<string>")
    return rows.select(
        "question_id", F.when(own, F.col("l.answer")).otherwise("").alias("answer"), F.when(own, F.col("l.abstained")).otherwise(True).alias("abstained"),
        F.when(~own, reason).alias("abstention_reason"), F.when(own, F.col("l.citations")).otherwise(F.coalesce("l.retrieved_chunk_ids", none)).alias("citations"),
    )
