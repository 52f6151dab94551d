"""Consistency checks of benchmark questions and review labels: one row per finding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieval import bounded

REQUIRED = (
    "question_id", "question", "answerable", "topic", "question_type", "difficulty", "requires_multi_chunk", "requires_multi_doc", "gold_doc_ids", "gold_chunk_ids",
    "gold_answer_short", "evidence", "qrels", "unanswerable_type", "negative_rationale", "near_miss_doc_ids", "notes",
)
GRADES = (0, 1, 2, 3)
SEVERITIES = ("none", "minor", "major")


# The wording of findings, after the id of their question.
MESSAGES = {
    "missing_fields": "missing required fields: ",
    "not_boolean": "answerable must be a boolean",
    "unknown_gold_doc": "unknown gold_doc_id ",
    "unknown_gold_chunk": "unknown gold_chunk_id ",
    "no_gold_docs": "answerable question has no gold_doc_ids",
    "no_gold_chunks": "answerable question has no gold_chunk_ids",
    "no_gold_answer": "answerable question has no gold_answer_short",
    "no_relevant_qrel": "answerable question needs at least one relevance=3 qrel",
    "has_unanswerable_type": "answerable question should have null unanswerable_type",
    "has_rationale": "answerable question should have null negative_rationale",
    "has_gold": "unanswerable question should not have gold ids",
    "has_gold_answer": "unanswerable question should have null gold_answer_short",
    "has_evidence": "unanswerable question should not have evidence",
    "has_relevant_qrel": "unanswerable question cannot have relevance=3 qrel",
    "no_unanswerable_type": "unanswerable question needs unanswerable_type",
    "no_rationale": "unanswerable question needs negative_rationale",
    "no_near_miss": "unanswerable question has no near_miss_doc_ids",
    "no_quote": "missing quote",
    "quote_not_found": "quote not found in chunk text",
    "bad_grade": "relevance must be one of [0, 1, 2, 3]",
    "duplicate_id": "duplicate question_id values: ",
    "near_duplicate": "near-duplicate normalized question text: ",
}


def missing_fields(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """(question_id, severity, rule, message) for raw JSON lines that lack a key; null values are present."""
    lost = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.json_object_keys(json_col)))
    rows = lines.select(F.get_json_object(json_col, "$.question_id").alias("question_id"), lost.alias("lost")).filter(F.size("lost") > 0)
    return _found(rows, "missing_fields", F.concat(F.lit(MESSAGES["missing_fields"]), F.array_join("lost", ", ")))


def not_boolean(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """Findings for raw JSON lines whose ``answerable`` is there but neither true nor false."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_col), "$.answerable", "variant"))
    rows = lines.filter(F.array_contains(F.json_object_keys(json_col), "answerable") & ~kind.eqNullSafe("BOOLEAN"))
    return _found(rows.select(F.get_json_object(json_col, "$.question_id").alias("question_id")), "not_boolean", MESSAGES["not_boolean"])


def _found(rows: DataFrame, rule: str, message: Column | str, severity: str = "error") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.col("question_id").cast("string").alias("question_id"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text.alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _listed(rows: DataFrame, rules: list[tuple[str, Column, Column | None]], warnings: tuple[str, ...] = ()) -> DataFrame:
    """One finding for each (rule, test, message) whose test holds, in one pass; the message is the rule's own by default."""
    made = [
        F.when(test, F.struct(F.lit("warning" if n in warnings else "error").alias("severity"), F.lit(n).alias("rule"), (F.lit(MESSAGES[n]) if m is None else m).alias("message")))
        for n, test, m in rules
    ]
    found = rows.select(F.col("question_id").cast("string").alias("question_id"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f"))
    return found.select("question_id", "f.severity", "f.rule", "f.message")


def row_rules(questions: DataFrame) -> DataFrame:
    """The rules that need one question only; a question that is null for answerable counts as unanswerable."""
    has = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    full = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    judged = F.coalesce(F.exists("qrels", lambda r: r["relevance"] == 3), F.lit(False))
    yes = F.coalesce("answerable", F.lit(False))
    tests = [
        ("no_gold_docs", yes & ~has("gold_doc_ids")), ("no_gold_chunks", yes & ~has("gold_chunk_ids")), ("no_gold_answer", yes & ~full("gold_answer_short")),
        ("no_relevant_qrel", yes & ~judged), ("has_unanswerable_type", yes & F.col("unanswerable_type").isNotNull()), ("has_rationale", yes & F.col("negative_rationale").isNotNull()),
        ("has_gold", ~yes & (has("gold_doc_ids") | has("gold_chunk_ids"))), ("has_gold_answer", ~yes & F.col("gold_answer_short").isNotNull()), ("has_evidence", ~yes & has("evidence")),
        ("has_relevant_qrel", ~yes & judged), ("no_unanswerable_type", ~yes & ~full("unanswerable_type")), ("no_rationale", ~yes & ~full("negative_rationale")),
        ("no_near_miss", ~yes & ~has("near_miss_doc_ids")),
    ]
    return _listed(questions, [(n, t, None) for n, t in tests], warnings=("no_near_miss",))


def references(questions: DataFrame) -> DataFrame:
    """Every id that a question refers to, one a row: kind, i (its place), chunk_id, doc_id, quote, relevance, gold_doc_ids."""
    ids = questions.schema["gold_doc_ids"].dataType.elementType.simpleString()
    kind = f"array<struct<kind:string,i:int,chunk_id:string,doc_id:{ids},quote:string,relevance:int>>"

    def part(name: str, items: str, of: Callable[[Column], dict[str, Column]]) -> Column:
        none = {c: F.lit(None) for c in ("chunk_id", "doc_id", "quote", "relevance")}
        each = lambda x, i: F.struct(F.lit(name).alias("kind"), i.alias("i"), *[v.alias(c) for c, v in (none | of(x)).items()])
        return F.coalesce(F.transform(items, each).cast(kind), F.array().cast(kind))

    of = lambda *names: lambda x: {n: x[n] for n in names}
    parts = [
        part("gold_doc", "gold_doc_ids", lambda x: {"doc_id": x}), part("gold_chunk", "gold_chunk_ids", lambda x: {"chunk_id": x}),
        part("evidence", "evidence", of("chunk_id", "doc_id", "quote")), part("qrels", "qrels", of("chunk_id", "doc_id", "relevance")),
    ]
    return questions.select("question_id", "gold_doc_ids", F.explode(F.concat(*parts)).alias("x")).select("question_id", "gold_doc_ids", "x.*")


#: Distinct references are broadcast up to this count, else the join is shuffled.
BROADCAST_REFERENCES = 200_000


def reference_rules(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids that no chunk has, ids that disagree, quotes that are not in their chunk, unknown grades.

    Of an unknown chunk nothing more is said.  Chunks are read once, for the referred ones; of chunks
    that share an id the last counts.
    """
    refs = references(questions)
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("id"))
    own = F.when(F.col("kind") == "gold_doc", key("doc", F.col("doc_id"))).otherwise(key("chunk", F.col("chunk_id")))
    refs = refs.withColumn("at", own)
    wanted = bounded(refs.select("at").distinct(), BROADCAST_REFERENCES)
    read = chunks.select("chunk_id", F.col("doc_id").alias("k_doc"), "text", F.monotonically_increasing_id().alias("place"))
    read = read.select("*", F.explode(F.array(key("doc", F.col("k_doc")), key("chunk", F.col("chunk_id")))).alias("at")).join(wanted, "at")
    text = F.when(F.col("at.kind") == "chunk", F.col("text"))
    known = read.groupBy("at").agg(F.max_by(F.struct("k_doc", text.alias("k_text")), "place").alias("known"))
    rows = refs.join(known, "at", "left").select("*", F.col("known.k_doc").alias("k_doc"), F.col("known.k_text").alias("k_text"), F.col("known").isNotNull().alias("there"))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    place = F.concat("kind", F.lit("["), F.col("i").cast("string"), F.lit("]: "))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    no_quote = F.coalesce(F.col("quote"), F.lit("")) == ""
    listed = F.coalesce(F.array_contains("gold_doc_ids", F.col("k_doc")), F.lit(False))
    there, cited = F.col("there"), is_("evidence", "qrels")
    rules = [
        ("unknown_gold_doc", is_("gold_doc") & ~there, text(MESSAGES["unknown_gold_doc"], shown("doc_id"))),
        ("unknown_gold_chunk", is_("gold_chunk") & ~there, text(MESSAGES["unknown_gold_chunk"], shown("chunk_id"))),
        ("gold_chunk_doc", is_("gold_chunk") & there & ~listed, text("gold_chunk_id ", shown("chunk_id"), " doc_id is not in gold_doc_ids")),
        ("unknown_chunk", cited & ~there, text(place, "unknown chunk_id ", shown("chunk_id"))),
        ("other_doc", cited & there & ~F.col("doc_id").eqNullSafe(F.col("k_doc")), text(place, "doc_id ", shown("doc_id"), " does not match chunk ", shown("chunk_id"))),
        ("no_quote", is_("evidence") & there & no_quote, text(place, MESSAGES["no_quote"])),
        ("quote_not_found", is_("evidence") & there & ~no_quote & ~F.contains("k_text", "quote"), text(place, MESSAGES["quote_not_found"])),
        ("bad_grade", is_("qrels") & there & ~F.coalesce(F.col("relevance").isin(*GRADES), F.lit(False)), text(place, MESSAGES["bad_grade"])),
    ]
    return _listed(rows, rules)


def duplicate_ids(questions: DataFrame) -> DataFrame:
    """One finding that lists all repeated ids in order, or none."""
    again = questions.groupBy(F.col("question_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ids = again.agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 0)  # of a benchmark
    return _found(ids.withColumn("question_id", F.lit(None)), "duplicate_id", F.concat(F.lit(MESSAGES["duplicate_id"]), F.array_join("ids", ", ")))


def near_duplicate_pairs(questions: DataFrame, id_col: str = "question_id", text_col: str = "question", order_col: str = "row") -> DataFrame:
    """(first_id, second_id): all pairs of rows whose folded texts are equal, in the order of ``order_col``.

    All pairs are the feature here, so the result grows with the square of a group: it is for the
    questions of a benchmark.  Whole collections take :func:`near_duplicate_groups`.
    """
    keyed = questions.select(F.col(id_col).alias("id"), tx.fold_question(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(order_col if order_col in questions.columns else id_col).alias("at"))
    left, right = (keyed.select(F.col("id").alias(f"{n}_id"), "key", F.col("at").alias(f"{n}_at")) for n in ("first", "second"))
    return left.join(right, "key").filter("first_at < second_at").select("first_id", "second_id")


def near_duplicate_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, group_id, group_size) of every row: the smallest id whose folded text is equal, and how many are.

    Two pairs of rows are near duplicates exactly if they share a group, so no pair is written.
    Digests are counted with map-side aggregation and joined back; a hot group is one row there.
    """
    keyed = rows.select(F.col(id_col), F.sha2(tx.fold_question(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("__key"))
    groups = keyed.groupBy("__key").agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(groups, "__key").select(id_col, "group_id", "group_size")


def duplicate_rules(questions: DataFrame) -> DataFrame:
    """Repeated ids and questions alike but for case and punctuation."""
    alike = near_duplicate_pairs(questions).withColumn("question_id", F.col("first_id"))
    pair = F.concat(F.lit(MESSAGES["near_duplicate"]), F.col("first_id").cast("string"), F.lit(" and "), F.col("second_id").cast("string"))
    return _union([duplicate_ids(questions), _found(alike, "near_duplicate", pair, "warning")])


def validate(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """All findings of the row, reference and duplicate rules; a column ``row``, if there is one, is the order of questions."""
    return _union([row_rules(questions), reference_rules(questions, chunks), duplicate_rules(questions)])


def summary(questions: DataFrame) -> DataFrame:
    """(scope, value, n): counts by answerability, topic, type, difficulty and gold document, in one pass."""
    of = lambda scope, c: F.struct(F.lit(scope).alias("scope"), c.cast("string").alias("value"))
    own = [of("answerability", F.when(F.col("answerable"), "answerable").otherwise("unanswerable")), of("topic", F.col("topic")), of("question_type", F.col("question_type")), of("difficulty", F.col("difficulty"))]
    gold = F.transform(F.coalesce("gold_doc_ids", F.array().cast("array<string>")), lambda d: of("gold_doc", d))
    rows = questions.select(F.explode(F.concat(F.array(*own), gold)).alias("x"))
    return rows.groupBy("x.scope", "x.value").agg(F.count(F.lit(1)).alias("n"))


def gate(findings: DataFrame, most: int = 20) -> None:
    """Raises if there are errors; shows the first few."""
    errors = findings.filter("severity = 'error'").orderBy("question_id", "rule").limit(most).collect()
    if errors:
        raise ValueError("; ".join(f"{r['question_id']}: {r['message']}" for r in errors))


def label_findings(reviews: DataFrame, no_retrieval: str = "non_rag") -> DataFrame:
    """(question_id, kind, message): missing labels and labels that contradict each other."""
    null = lambda c: F.col(c).isNull()
    severity, wrong = F.col("review_hallucination_severity"), F.col("manual_hallucinated")
    rules = [
        ("missing", null("manual_correct"), F.lit("manual_correct")),
        ("missing", null("manual_hallucinated"), F.lit("manual_hallucinated")),
        ("missing", null("review_hallucination_severity"), F.lit("review_hallucination_severity")),
        ("missing", ~F.coalesce("answerable", F.lit(False)) & null("review_abstention_correct"), F.lit("review_abstention_correct")),
        ("missing", ~F.col("system").eqNullSafe(no_retrieval) & null("manual_citation_supported"), F.lit("manual_citation_supported")),
        ("invalid", severity.isNotNull() & ~severity.isin(*SEVERITIES), F.concat(F.lit("severity="), severity)),
        ("invalid", wrong & (severity == "none"), F.lit("hallucinated without severity")),
        ("invalid", ~wrong & severity.isin("minor", "major"), F.concat(F.lit("not hallucinated but "), severity)),
    ]
    made = F.array(*[F.when(test, F.struct(F.lit(k).alias("kind"), m.alias("message"))) for k, test, m in rules])
    rows = reviews.select("question_id", "system", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f"))
    return rows.select("question_id", "system", "f.kind", "f.message")


def label_gate(reviews: DataFrame) -> None:
    """Missing labels are reported before contradictions, and hide them."""
    for kind in ("missing", "invalid"):
        found = label_findings(reviews).filter(F.col("kind") == kind).orderBy("question_id").limit(20).collect()
        if found:
            raise ValueError(f"{kind} reviewed labels: " + ", ".join(f"{r['question_id']}:{r['message']}" for r in found))
