"""Citation heuristics, review templates, label aggregation and the explorer's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .generation import SYSTEMS

_NONE = "array<string>"


def _rate(flag: Column, where: Column | None = None) -> Column:
    """The share of true; null counts as false, no rows give 0.0."""
    value = F.coalesce(flag, F.lit(False)).cast("double")
    return F.round(F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0)), 6)


def analyse(generations: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Flags of each generation: do its citations exist, were they retrieved, is a gold one among them.

    ``generations``: question_id, system, abstained, answer, citations, retrieved_chunk_ids;
    ``questions``: question_id, answerable, gold_chunk_ids (grade-3 ones included).  A generation of an
    unknown question is an error.  Duplicate and unknown citations stay as cited, in order.
    """
    lost = generations.join(questions, "question_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"generation of an unknown question: {lost[0]['question_id']}")
    rows = generations.join(questions.select("question_id", "answerable", "gold_chunk_ids"), "question_id")
    cited = rows.select("question_id", "system", F.posexplode("citations").alias("pos", "chunk_id"))
    lost = cited.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    missing = lost.groupBy("question_id", "system").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("missing_citations"))
    rows = rows.join(missing, ["question_id", "system"], "left").withColumn("missing_citations", F.coalesce("missing_citations", F.array().cast(_NONE)))
    outside = F.when(F.size("retrieved_chunk_ids") > 0, F.filter("citations", lambda c: ~F.array_contains("retrieved_chunk_ids", c))).otherwise(F.array().cast(_NONE))
    return rows.select(
        "question_id", "system", "answerable", "abstained", (~F.col("abstained")).alias("answered"), F.size("citations").alias("citation_count"),
        (F.size("missing_citations") == 0).alias("citations_exist"), (F.size(outside) == 0).alias("citations_in_retrieved"),
        F.arrays_overlap("citations", "gold_chunk_ids").alias("has_gold_citation"), "missing_citations", outside.alias("not_retrieved_citations"),
        (tx.strip(F.coalesce("answer", F.lit(""))) != "").alias("answer_nonempty"),
    )


def heuristic_metrics(analysed: DataFrame) -> DataFrame:
    """One row per system; rates over answerable questions include abstentions."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    return analysed.groupBy("system").agg(
        F.count(F.lit(1)).alias("num_generations"), _rate(F.col("answered")).alias("answer_rate"), _rate(F.col("abstained")).alias("abstention_rate"),
        F.count_if(yes).alias("num_answerable"), _rate(F.col("abstained"), yes).alias("over_abstention_rate"), _rate(F.col("answered"), yes).alias("answered_rate"),
        _rate(F.col("has_gold_citation"), yes).alias("gold_citation_hit_rate"), F.count_if(no).alias("num_unanswerable"),
        _rate(F.col("abstained"), no).alias("correct_abstention_rate"), _rate(F.col("answered"), no).alias("false_answer_rate"),
        _rate(F.col("citations_exist")).alias("citation_validity_rate"), _rate(F.col("citations_in_retrieved")).alias("citation_in_retrieved_rate"),
        F.round(F.avg("citation_count"), 6).alias("avg_citation_count"),
    )


def review_template(generations: DataFrame, questions: DataFrame) -> DataFrame:
    """What a reviewer fills in: labels are typed nulls."""
    rows = generations.join(questions.select("question_id", "question", "answerable", "gold_chunk_ids"), "question_id")
    blank = {c: F.lit(None).cast("boolean") for c in ("manual_correct", "manual_citation_supported", "manual_hallucinated", "review_abstention_correct")}
    return rows.withColumns({**blank, "review_hallucination_severity": F.lit(None).cast("string"), "manual_notes": F.lit("")})


def reviewed_metrics(reviews: DataFrame) -> DataFrame:
    """One row per system from human labels; an empty review is an error."""
    if reviews.isEmpty():
        raise ValueError("there are no reviewed rows")
    yes, no = F.coalesce("answerable", F.lit(False)), ~F.coalesce("answerable", F.lit(False))
    correct, wrong, refused = F.col("manual_correct"), F.col("manual_hallucinated"), F.col("review_abstention_correct")
    cited = F.col("manual_citation_supported")
    return reviews.groupBy("system").agg(
        F.count(F.lit(1)).alias("num_reviewed"), _rate(correct).alias("reviewed_correct_rate"), _rate(wrong).alias("reviewed_hallucination_rate"),
        _rate(F.col("review_hallucination_severity") == "major").alias("major_hallucination_rate"),
        F.count_if(yes).alias("num_answerable"), _rate(correct, yes).alias("answerable_accuracy"), _rate(wrong, yes).alias("answerable_hallucination_rate"),
        _rate(F.col("abstained"), yes).alias("over_abstention_rate"), F.count_if(no).alias("num_unanswerable"), _rate(refused, no).alias("correct_refusal_rate"),
        _rate(~F.coalesce(refused, F.lit(False)), no).alias("false_answer_rate"), _rate(wrong, no).alias("unanswerable_hallucination_rate"),
        F.count(cited).alias("num_citation_rows"), _rate(cited, cited.isNotNull()).alias("citation_support_rate"),
    )


def has_issue() -> Column:
    """A label that says so; a missing label never does."""
    is_ = lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    return is_("manual_correct", False) | is_("manual_citation_supported", False) | is_("manual_hallucinated", True) | is_("review_abstention_correct", False)


def flagged_rows(reviews: DataFrame) -> DataFrame:
    return reviews.filter(has_issue()).select("question_id", "system", "manual_correct", "manual_citation_supported", "manual_hallucinated")


# Explorer ------------------------------------------------------------------------------------


def issue_counts(reviews: DataFrame) -> DataFrame:
    """Per question, over all systems."""
    return reviews.groupBy("question_id").agg(
        F.count_if(F.col("manual_correct")).alias("correct"), F.count_if(F.col("manual_hallucinated")).alias("hallucinated"),
        F.count_if(~F.col("manual_citation_supported")).alias("unsupported_citation"),
    )


def explore(questions: DataFrame, reviews: DataFrame, text: str = "", topic: str | None = None, difficulty: str | None = None, answerable: bool | None = None, issues_only: bool = False) -> DataFrame:
    """Questions that pass every given filter; ``text`` is looked for in id and question, whatever the case."""
    out = questions
    if text:
        out = out.filter(F.contains(F.lower("question"), F.lit(text.lower())) | F.contains(F.lower(F.col("question_id").cast("string")), F.lit(text.lower())))
    for column, value in (("topic", topic), ("difficulty", difficulty), ("answerable", answerable)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.join(reviews.filter(has_issue()), "question_id", "left_semi") if issues_only else out


def facets(questions: DataFrame, columns: tuple[str, ...] = ("topic", "difficulty")) -> DataFrame:
    rows = questions.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return rows.select("x.*").distinct()


def system_summary(metrics: DataFrame, no_retrieval: str = "non_rag") -> DataFrame:
    """The summary table in the fixed order of systems; citation support is n/a without retrieval."""
    order = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system")).cast("int")
    support = F.when(F.col("system") == no_retrieval, F.lit("n/a")).otherwise(tx.percent(F.col("citation_support_rate")))
    return metrics.select(
        order.alias("position"), tx.title_case(F.col("system")).alias("name"), tx.percent(F.col("reviewed_correct_rate")).alias("correct"),
        tx.percent(F.col("reviewed_hallucination_rate")).alias("hallucinated"), support.alias("citation_support"),
    )


def shown_answer(answer: Column, reason: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), F.nullif(reason, F.lit("")), F.lit("No answer recorded."))


# What the explorer shows of a question and of a review.
QUESTION_COLUMNS = (
    "question_id", "question", "answerable", "topic", "difficulty", "question_type", "gold_answer_short", "gold_chunk_ids", "gold_doc_ids", "negative_rationale",
)
REVIEW_COLUMNS = (
    "question_id", "system", "question", "answerable", "gold_answer_short", "gold_chunk_ids", "model_answer", "abstained", "abstention_reason", "citations", "retrieved_chunk_ids",
    "manual_correct", "manual_citation_supported", "manual_hallucinated", "review_abstention_correct", "review_hallucination_severity", "manual_notes",
)


def compact_questions(questions: DataFrame) -> DataFrame:
    return questions.select(*QUESTION_COLUMNS)


def compact_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.select(*REVIEW_COLUMNS)


def bundle(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per question with its reviews keyed by system; of repeated reviews the last by value counts."""
    labels = F.struct(*[c for c in REVIEW_COLUMNS if c in reviews.columns and c not in ("question_id", "system")])
    once = reviews.groupBy("question_id", "system").agg(F.max(labels).alias("review"))
    keyed = once.groupBy("question_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "review")))).alias("reviews"))  # one a system
    return questions.join(keyed, "question_id", "left")


def question_detail(questions: DataFrame, reviews: DataFrame, shown: DataFrame | None = None, selected: str | None = None, order: str = "question_id") -> DataFrame:
    """The selected question, else the first of those ``shown``, else the first: one row per system that has a review.

    ``gold`` is the gold answer of an answerable question and the rationale of another; a question
    without reviews has one row without a system.
    """
    shown = questions if shown is None else shown
    rank = F.when(F.col("question_id").cast("string").eqNullSafe(F.lit(selected)), 0).when(F.col("__shown"), 1).otherwise(2)
    marked = questions.join(shown.select("question_id", F.lit(True).alias("__shown")).distinct(), "question_id", "left").withColumn("__rank", rank)
    one = marked.orderBy("__rank", order).limit(1)
    gold = F.when(F.col("answerable"), F.col("gold_answer_short")).otherwise(F.col("negative_rationale"))
    place = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system")).cast("int")
    kept = reviews.select("question_id", "system", place.alias("position"), *[c for c in reviews.columns if c not in one.columns and c != "system"]).filter("position > 0")
    return one.select("question_id", "question", "answerable", gold.alias("gold")).join(kept, "question_id", "left")
