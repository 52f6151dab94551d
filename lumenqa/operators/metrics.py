"""Ranking metrics over judged results, and question-by-question comparison of two rankers.

A judged row is (question_id, rank, chunk_id, doc_id, score, relevance, is_gold_doc, is_near_miss_doc).
A result is relevant from grade 3 on; grades 1 and 2 count for nDCG only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RELEVANT = 3
CUTS = (1, 3, 5, 10)


def k_values(top_k: int) -> list[int]:
    return sorted({k for k in CUTS if k <= top_k} | {top_k})


def last_grades(qrels: DataFrame) -> DataFrame:
    """(question_id, chunk_id, relevance): of several grades the last by ``pos`` counts, without that column the highest."""
    last = F.max_by("relevance", "pos") if "pos" in qrels.columns else F.max("relevance")
    return qrels.groupBy("question_id", "chunk_id").agg(last.alias("relevance"))


def judge(ranked: DataFrame, qrels: DataFrame, near_miss: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Ranked rows with relevance (0 if unjudged) and the gold and near-miss flags of their documents.

    ``qrels``: question_id, chunk_id, doc_id, relevance and, if there is an order, pos.
    ``gold``: question_id, doc_id; by default the documents with a relevant grade.
    """
    grades = last_grades(qrels)
    gold = qrels.filter(F.col("relevance") >= RELEVANT) if gold is None else gold
    gold = gold.select("question_id", "doc_id").distinct().withColumn("g", F.lit(True))
    near = near_miss.select("question_id", "doc_id").distinct().withColumn("m", F.lit(True))
    joined = ranked.join(grades, ["question_id", "chunk_id"], "left").join(gold, ["question_id", "doc_id"], "left").join(near, ["question_id", "doc_id"], "left")
    flags = {"relevance": F.coalesce("relevance", F.lit(0)), "is_gold_doc": F.coalesce("g", F.lit(False)), "is_near_miss_doc": F.coalesce("m", F.lit(False))}
    return joined.withColumns(flags).drop("g", "m")


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def per_question(questions: DataFrame, judged: DataFrame, qrels: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per question with its reciprocal rank and, for each k, recall, doc recall, nDCG, near miss.

    Questions without results stay, with zeros.  The ideal of nDCG comes from all positive grades.
    """
    cuts = k_values(top_k)
    hit = F.col("relevance") >= RELEVANT
    aggs = [F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score")]
    for k in cuts:
        inside = F.col("rank") <= k
        aggs += [
            F.max((inside & hit).cast("int")).alias(f"recall@{k}"), F.max((inside & F.col("is_gold_doc")).cast("int")).alias(f"doc_recall@{k}"),
            F.max((inside & F.col("is_near_miss_doc")).cast("int")).alias(f"near_miss_doc@{k}"), F.sum(F.when(inside, gain(F.col("relevance"), F.col("rank")))).alias(f"dcg@{k}"),
        ]
    got = judged.groupBy("question_id").agg(*aggs)
    best = last_grades(qrels).filter("relevance > 0")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("relevance")))
    best = best.withColumn("place", place).filter(F.col("place") <= top_k)
    ideal = best.groupBy("question_id").agg(*[F.sum(F.when(F.col("place") <= k, gain(F.col("relevance"), F.col("place")))).alias(f"ideal@{k}") for k in cuts])
    joined = questions.join(got, "question_id", "left").join(ideal, "question_id", "left")
    out = [F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), "first_rank", "top_score"]
    for k in cuts:
        out += [F.coalesce(F.col(f"{m}@{k}"), F.lit(0)).cast("double").alias(f"{m}@{k}") for m in ("recall", "doc_recall", "near_miss_doc")]
        out.append(F.coalesce(F.col(f"dcg@{k}") / F.nullif(F.col(f"ideal@{k}"), F.lit(0.0)), F.lit(0.0)).alias(f"ndcg@{k}"))
    return joined.select(*questions.columns, *out)


def _long(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    entry = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    return wide.select(*keys, F.explode(F.array(*entry)).alias("m")).select(*keys, "m.metric", F.round("m.value", 6).alias("value"))


def answerable_metrics(rows: DataFrame, top_k: int = 10, slices: tuple[str, ...] = ("topic", "question_type", "difficulty")) -> DataFrame:
    """(slice, value_of_slice, metric, value): all answerable questions and each slice, in one pass."""
    names = ["mrr", *[f"{m}@{k}" for k in k_values(top_k) for m in ("recall", "doc_recall", "ndcg")]]
    aggs = [F.count(F.lit(1)).alias("num_questions"), *[F.avg("reciprocal_rank" if n == "mrr" else f"`{n}`").alias(n) for n in names]]
    picked = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("group")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("group")) for s in slices])
    wide = rows.filter("answerable").withColumn("s", F.explode(picked)).groupBy("s.slice", "s.group").agg(*aggs)
    return _long(wide, ["slice", "group"], ["num_questions", *names])


def unanswerable_metrics(rows: DataFrame, top_k: int = 10) -> DataFrame:
    """(metric, value) of the unanswerable questions; top scores count questions with results only."""
    near = [f"near_miss_doc@{k}" for k in k_values(top_k)]
    aggs = [F.count(F.lit(1)).alias("num_questions"), F.coalesce(F.avg("top_score"), F.lit(0.0)).alias("avg_top_score"), F.coalesce(F.max("top_score"), F.lit(0.0)).alias("max_top_score")]
    wide = rows.filter("not answerable").groupBy().agg(*aggs, *[F.avg(f"`{n}`").alias(n) for n in near]).filter("num_questions > 0")
    return _long(wide, [], ["num_questions", "avg_top_score", "max_top_score", *near])


def predictions(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """One nested row per question, results in rank order."""
    item = F.struct("rank", "chunk_id", "doc_id", "score", "relevance", "is_gold_doc", "is_near_miss_doc")
    nested = judged.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("retrieved"))
    return questions.join(nested, "question_id", "left")


# Comparison of two rankers -------------------------------------------------------------------

BUCKETS = ("both_hit", "left_only", "right_only", "both_miss")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """The answerable questions of both; differing question sets are an error."""
    for a, b, side in ((left, right, "right"), (right, left, "left")):
        lost = a.join(b, "question_id", "left_anti").select("question_id").limit(5).collect()
        if lost:
            raise ValueError(f"questions without {side} results: {', '.join(str(r[0]) for r in lost)}")
    return left.filter("answerable").join(right.select("question_id", *[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns if "@" in c or c == "first_rank"]), "question_id")


def bucket(k: int) -> Column:
    a, b = F.col(f"`recall@{k}`") > 0, F.col(f"`r_recall@{k}`") > 0
    return F.when(a & b, "both_hit").when(a, "left_only").when(b, "right_only").otherwise("both_miss")


def contingency(both: DataFrame, top_k: int = 10) -> DataFrame:
    """(k, bucket, n, question_ids): all four buckets for each k, empty ones with 0."""
    spark = both.sparkSession
    rows = both.select("question_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bucket(k).alias("bucket")) for k in k_values(top_k)])).alias("x"))
    got = rows.groupBy("x.k", "x.bucket").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("question_id")).alias("question_ids"))
    every = spark.createDataFrame([(k, b) for k in k_values(top_k) for b in BUCKETS], "k int, bucket string")
    empty = F.array().cast(got.schema["question_ids"].dataType)
    return every.join(got, ["k", "bucket"], "left").select("k", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("question_ids", empty).alias("question_ids"))


def contingency_by(both: DataFrame, top_k: int = 10, slices: tuple[str, ...] = ("topic", "question_type", "difficulty")) -> DataFrame:
    """(slice, group, k, one count per bucket)."""
    at = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("group"), F.lit(k).alias("k"), bucket(k).alias("bucket")) for s in slices for k in k_values(top_k)])
    rows = both.select(F.explode(at).alias("x")).select("x.*")
    return rows.groupBy("slice", "group", "k").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def comparison_detail(both: DataFrame, left_ranked: DataFrame, right_ranked: DataFrame) -> DataFrame:
    """Per question: the first relevant rank and the top chunk of each side (null if none)."""
    top = lambda df, name: df.filter("rank = 1").select("question_id", F.col("chunk_id").alias(name))
    rows = both.select("question_id", F.col("first_rank").alias("left_rank"), F.col("r_first_rank").alias("right_rank"))
    return rows.join(top(left_ranked, "left_top"), "question_id", "left").join(top(right_ranked, "right_top"), "question_id", "left")
