"""The standard tables as chunks, questions, judgements, generations and reviews.

Each record is built once here with DataFrame functions and once in :mod:`.oracles` in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import exploded, let
from ..operators import chunking
from ..operators.generation import SYSTEMS
from ..operators.retrieval import bounded
from ..operators.validation import REQUIRED
from ..sources.scratch import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def chunk_id(doc_id) -> F.Column:
    return F.concat(doc_id.cast("string"), F.lit("__0000"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a chunk; a short first line is its section."""
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    section = F.when((F.instr("text", "\n") > 0) & (tx.word_count(first) <= 14), first)
    return docs.select("doc_id", chunk_id(F.col("doc_id")).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("title"), F.col("lang").alias("topic"), section.alias("section"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents cut into passages, as chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("topic"))
    return chunking.chunk_documents(docs, fields=("title", "topic"))


@dataclass
class Benchmark:
    """What the documents say about the benchmark's items, written once: every judgement is a small table.

    * ``facts``: (role, question_id, doc_id, lang) with role "gold" for documents that hold the item's
      text, "next" for the ids after those and "near" for about 25 ids at equal distances.
    * ``items``: question_id, question.
    """

    facts: DataFrame
    items: DataFrame

    def judgements(self) -> DataFrame:
        """question_id, chunk_id, doc_id, relevance: 3 for gold documents, 1 for the ids after them."""
        gold = self.facts.filter("role = 'gold'").select("question_id", "doc_id")
        following = self.facts.filter("role = 'next'").join(gold.select("question_id", (F.col("doc_id") + 1).alias("doc_id")), ["question_id", "doc_id"], "left_semi")
        nxt = following.select("question_id", "doc_id").distinct().join(gold, ["question_id", "doc_id"], "left_anti")
        both = gold.withColumn("relevance", F.lit(3)).unionByName(nxt.withColumn("relevance", F.lit(1)))
        return both.select("question_id", chunk_id(F.col("doc_id")).alias("chunk_id"), "doc_id", "relevance")

    def questions(self) -> DataFrame:
        """question_id, question, answerable, topic, question_type, difficulty."""
        gold = self.facts.filter("role = 'gold'").groupBy("question_id").agg(F.min_by("lang", "doc_id").alias("topic"))
        size = F.char_length("question")
        rows = self.items.select(
            "question_id", "question", F.concat(F.lit("t"), F.col("question_id") % 3).alias("question_type"), F.when(size < 150, "easy").when(size < 250, "medium").otherwise("hard").alias("difficulty")
        ).join(gold, "question_id", "left")
        return rows.select("question_id", "question", F.col("topic").isNotNull().alias("answerable"), F.coalesce("topic", F.lit("none")).alias("topic"), "question_type", "difficulty")

    def near_misses(self) -> DataFrame:
        """(question_id, doc_id) of unanswerable questions."""
        unanswerable = self.questions().filter("not answerable").select("question_id")
        return self.facts.filter("role = 'near'").select("question_id", "doc_id").join(unanswerable, "question_id", "left_semi")


#: Words of an item that stand for it: whole words, as neither the first nor the last is among them.
ANCHOR_WORDS = 3
#: Up to this many first words of anchors are looked for in the row, else all words of a document are hashed three by three.
LITERAL_HEADS = 2_000


def benchmark(spark: SparkSession, sf_dir: str) -> Benchmark:
    """Two scans of the documents: three words in a row point out which may hold an item, then the text decides.

    Items are a query set of bounded size, candidates are broadcast while few; no item meets a
    document that lacks its words (items of under five words have none and meet all).  The first of
    the three is the longest there is: few places of a document begin with it, and only those are hashed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    items = written(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), "benchmark")
    three = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(ANCHOR_WORDS)])

    def anchor(w):
        inner = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i + ANCHOR_WORDS < F.size(w))
        return F.array_max(F.transform(inner, lambda i: F.struct(F.char_length(F.get(w, i)).alias("size"), (-i).alias("place"), F.get(w, i).alias("head"), three(w, i).alias("anchor"))))

    marked = written(items.select("question_id", let(F.split("question", r"\s+"), anchor).alias("a")).select("question_id", "a.head", "a.anchor"), "benchmark")
    short = marked.filter("anchor is null").select("question_id")
    heads = [r[0] for r in marked.filter("anchor is not null").select("head").distinct().limit(LITERAL_HEADS + 1).collect()]

    def anchors(w):
        at = (lambda x, i: F.when(x.isin(heads), three(w, i))) if len(heads) <= LITERAL_HEADS else (lambda x, i: three(w, i))
        return F.array_distinct(F.filter(F.transform(w, at), lambda a: a.isNotNull()))

    places = exploded(docs, let(F.split("text", r"\s+"), anchors), "doc_id", names=("place", "anchor"))
    candidates = written(places.join(bounded(marked.select("question_id", "anchor").filter("anchor is not null"), 100_000), "anchor").select("doc_id", "question_id"), "benchmark")
    if not short.isEmpty():
        candidates = candidates.unionByName(docs.select("doc_id").crossJoin(F.broadcast(short)))
    most = docs.agg(F.max("doc_id")).first()[0] or 0  # reads ids only
    step = max(40, -(-(most + 1) // 25))
    at = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"))
    row = lambda df, role, kind, key: df.select("question_id", F.lit(role).alias("role"), at(kind, key).alias("at"))
    wanted = (
        row(candidates, "gold", "id", F.col("doc_id")).unionByName(row(candidates, "next", "id", F.col("doc_id") + 1)).distinct()
        .unionByName(row(items, "near", "residue", F.col("question_id") % 40))
    )
    found = docs.select("*", F.explode(F.array(at("id", F.col("doc_id")), at("residue", F.col("doc_id") % step))).alias("at")).join(bounded(wanted, 200_000), "at")
    found = found.join(bounded(items, 100_000), "question_id").filter("role <> 'gold' or contains(text, question)")
    return Benchmark(written(found.select("role", "question_id", "doc_id", "lang"), "benchmark"), items)


#: Copies of questions under the same id and under another one, with the text in other letters.
SAME_ID, OTHER_ID, ID_SHIFT = 17, 13, 100_000


def copied(rows: DataFrame) -> DataFrame:
    """``rows`` with planted copies; ``row`` is their order."""
    i = F.col("question_id")
    other = F.concat(tx.upper(F.col("question")), F.lit(" ?"))
    first, same = rows.withColumn("row", i), rows.filter(i % SAME_ID == 0).withColumn("row", i + 10 * ID_SHIFT)
    renamed = rows.filter(i % OTHER_ID == 0).withColumns({"row": i + 20 * ID_SHIFT, "question": other, "question_id": i + ID_SHIFT})
    return first.unionByName(same).unionByName(renamed)


def question_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, question_id, question of the benchmark with planted copies."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return copied(items)


def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested question records with planted faults, by id, and planted copies; written once."""
    known = benchmark(spark, sf_dir)
    near = known.near_misses().groupBy("question_id").agg(F.sort_array(F.collect_list("doc_id")).alias("near_miss_doc_ids"))  # about 25
    q = known.judgements().groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "doc_id", "relevance"))).alias("qrels"))
    rows = known.questions().join(q, "question_id", "left").join(near, "question_id", "left")
    i, yes = F.col("question_id"), F.col("answerable")
    grades = F.coalesce("qrels", F.array().cast("array<struct<chunk_id:string,doc_id:bigint,relevance:int>>"))
    gold = F.filter(grades, lambda r: r["relevance"] == 3)
    wrong = F.struct(F.lit("missing__0000").alias("chunk_id"), F.lit(-5).cast("long").alias("doc_id"), F.lit(7).alias("relevance"))
    first = F.when(i % 10 == 0, F.get(grades, F.lit(0))["chunk_id"])
    odd = F.struct(first.alias("chunk_id"), F.lit(-6).cast("long").alias("doc_id"), F.lit(9).alias("relevance"))
    some = lambda test, x: F.when(test, F.array(x)).otherwise(F.array().cast("array<struct<chunk_id:string,doc_id:bigint,relevance:int>>"))
    records = rows.select(
        i.alias("question_id"), "question", "answerable", "topic", "question_type", "difficulty",
        F.concat(F.transform(gold, lambda r: r["doc_id"]), F.when(i % 8 == 0, F.array(F.lit(-7).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("gold_doc_ids"),
        F.concat(F.transform(gold, lambda r: r["chunk_id"]), F.when(i % 7 == 0, F.array(F.lit("missing__0000"))).otherwise(F.array().cast("array<string>"))).alias("gold_chunk_ids"),
        F.when(yes & (i % 5 != 0), F.col("question")).alias("gold_answer_short"),
        F.transform(gold, lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["doc_id"].alias("doc_id"), F.when(i % 4 == 0, F.lit("not in the text")).when(i % 11 != 0, F.col("question")).alias("quote"))).alias("evidence"),
        F.concat(grades, some(i % 6 == 0, wrong), some(first.isNotNull(), odd)).alias("qrels"),
        F.when(~yes & (i % 3 != 0), F.lit("absent")).alias("unanswerable_type"), F.when(~yes | (i % 9 == 0), F.lit("why")).alias("negative_rationale"),
        F.coalesce("near_miss_doc_ids", F.array().cast("array<bigint>")).alias("near_miss_doc_ids"),
    )
    return written(copied(records), "records")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that follow a user's, with citations and retrieved ids by arithmetic on ids."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    i, t = F.col("conv_id"), F.col("turn")
    system = F.element_at(F.array(*map(F.lit, SYSTEMS)), (i % 6 + 1).cast("int"))
    empty = F.array().cast("array<string>")
    abstained, plain = F.char_length("text") < 300, i % 6 == 0
    one, two = chunk_id((i * 7 + t) % 1100), chunk_id((i * 3) % 1000)
    return rows.select(
        F.concat(i, F.lit("-"), t).alias("question_id"), system.alias("system"), "question", F.col("text").alias("answer"), abstained.alias("abstained"),
        F.when(abstained | plain, empty).otherwise(F.array(one, two)).alias("citations"),
        F.when(plain, empty).otherwise(F.array(one, chunk_id((i * 3 + i % 2) % 1000))).alias("retrieved_chunk_ids"),
        (i % 4 != 0).alias("answerable"), F.array(chunk_id((i * 3) % 1000)).alias("gold_chunk_ids"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as reviewed generations, with some labels left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    i, toxic, good = F.col("doc_id"), F.col("toxic") == 1, F.col("quality") == 1
    yes = i % 4 != 0
    return rows.select(
        i.alias("question_id"), F.element_at(F.array(*map(F.lit, SYSTEMS)), (i % 6 + 1).cast("int")).alias("system"), yes.alias("answerable"),
        (F.col("n_chars") < 500).alias("abstained"), F.when(i % 11 != 0, good).alias("manual_correct"), F.when(i % 5 != 0, good).alias("manual_citation_supported"),
        toxic.alias("manual_hallucinated"), F.when(~yes & (i % 8 == 0), ~toxic).alias("review_abstention_correct"),
        F.when(toxic & (i % 2 == 0), "major").when(toxic, "minor").when(i % 13 == 0, "minor").otherwise("none").alias("review_hallucination_severity"),
    )


def full_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with all their columns; six systems share a question."""
    i = F.col("question_id")
    made = {
        "question": F.concat(F.lit("q"), i), "gold_answer_short": F.when(i % 3 != 0, F.concat(F.lit("g"), i)), "gold_chunk_ids": F.array(chunk_id(i)), "model_answer": F.concat(F.lit("a"), i),
        "abstention_reason": F.when(F.col("abstained"), "short"), "citations": F.array(chunk_id(i + 1)), "retrieved_chunk_ids": F.array(chunk_id(i), chunk_id(i + 1)), "manual_notes": F.lit(""),
    }
    return reviews(spark, sf_dir).withColumns(made).withColumn("question_id", F.floor(i / len(SYSTEMS)).cast("long"))


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): a JSON line per benchmark item, some without a key and some with a null."""
    names = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~((F.col("item_id") % 5 == 0) & k.isin("notes", "qrels")) & ~((F.col("item_id") % 7 == 0) & (k == "topic")))
    value = lambda k: F.when(k == "question_id", F.concat(F.lit('"q'), F.col("item_id"), F.lit('"'))).when(k == "answerable", F.when(F.col("item_id") % 3 == 0, '"yes"').when(F.col("item_id") % 4 == 0, "null").otherwise("true")).otherwise("null")
    parts = F.transform(names, lambda k: F.concat(F.lit('"'), k, F.lit('": '), value(k)))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).alias("value"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
