"""The registered queries: each applies one operator group to the whole standard tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as tx
from ..operators import chunking, evaluation, generation, metrics, retrieval, validation
from ..sources import files
from ..sources.scratch import scratch_path, written
from . import bindings as bind

Query = Callable[[SparkSession, str], DataFrame]
TOP_K = 10
_registry: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registry[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_registry)


def _docs(spark, sf):
    return bind.table(spark, sf, "documents")


@query
def tokenize_counts(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query
def tokenize_no_stop(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.tokens(F.col("text"), remove_stopwords=False).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def expand_queries(spark, sf):
    items = bind.table(spark, sf, "benchmark")
    probe = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" Leave of Absence — discipline"))).otherwise(F.col("text"))
    return items.select("item_id", tx.expand_query(probe).alias("expanded"))


@query
def word_stats(spark, sf):
    text = F.col("text")
    return _docs(spark, sf).select("doc_id", tx.word_count(text).cast("long").alias("n_words"), tx.tail_words(text, 5).alias("tail"), tx.preview(text).alias("preview"))


@query
def normalize_question(spark, sf):
    return bind.table(spark, sf, "benchmark").select("item_id", tx.fold_question(F.col("text")).alias("folded"))


@query
def keyword_cleanup(spark, sf):
    rows = bind.table(spark, sf, "benchmark").select("item_id", tx.clean_keywords(F.concat(F.split("text", " "), F.array(F.lit("  The \t"), F.lit("")))).alias("k"))
    return rows.select("item_id", F.array_join("k", "|").alias("keywords"))


@query
def clean_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(cleaning.clean_html_text(F.concat(F.lit("\xa0 – a\t b\n\n\n"), F.col("text")))).alias("digest"))


@query
def line_flags(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", tx.strip(F.col("line")).alias("line"))
    line = F.col("line")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cleaning.is_contents_line(line)).alias("contents"), F.count_if(tx.is_title_line(line)).alias("titles"),
        F.count_if(tx.is_section_heading(line)).alias("headings"), F.count_if(tx.is_lettered_heading(line)).alias("lettered"), F.count_if(tx.is_metadata_line(line)).alias("metadata"),
    )


@query
def pdf_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", cleaning.clean_pdf_text(F.col("text")).alias("text"))


@query
def html_text(spark, sf):
    return files.extract_pages(bind.table(spark, sf, "pages"))


@query
def page_hashes(spark, sf):
    return bind.table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query
def section_blocks(spark, sf):
    rows = chunking.section_blocks(_docs(spark, sf))
    return rows.select("doc_id", F.col("block_index").cast("long").alias("block_index"), F.coalesce("section", F.lit("")).alias("section"), F.md5("block").alias("digest"))


@query
def sentence_split(spark, sf):
    s = _docs(spark, sf).select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query
def chunk_passages(spark, sf):
    return chunking.chunk_documents(_docs(spark, sf))


@query
def term_freq(spark, sf):
    """Counted in the row; only chunks that share an id are put together from their postings."""
    entries = written(_term_freq_entries(spark, sf), "term-freq")
    again = written(entries.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("chunk_id"), "term-freq")
    rows = entries.select("chunk_id", "n_terms", "length", "most", "named")
    if again.isEmpty():
        return rows
    shared = retrieval.summed(retrieval.postings(retrieval.weighted_terms(bind.chunks(spark, sf)).join(again, "chunk_id", "left_semi")))
    put = shared.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("length"), F.max("tf").alias("most"), F.count_if("named").alias("named"))
    return rows.join(again, "chunk_id", "left_anti").unionByName(put)


def _term_freq_entries(spark, sf):
    terms = F.col("terms")
    return retrieval.weighted_terms(bind.chunks(spark, sf)).filter("length > 0").select(
        "chunk_id", F.size(terms).cast("long").alias("n_terms"), "length", F.array_max(terms["tf"]).alias("most"), F.size(F.filter(terms["named"], lambda x: x)).cast("long").alias("named")
    )


@query
def doc_freq_idf(spark, sf):
    chunks = bind.chunks(spark, sf)
    n = F.broadcast(retrieval.corpus_stats(retrieval.weighted_terms(chunks, [])))  # one row
    again, rows = retrieval.repeated(chunks), retrieval.postings(retrieval.weighted_terms(chunks))
    if not again.isEmpty():  # reads ids only
        rows = rows.join(again, retrieval.CHUNK, "left_anti").unionByName(retrieval.summed(rows.join(again, retrieval.CHUNK, "left_semi")))
    rows = retrieval.document_frequencies(rows).crossJoin(n)
    return rows.select("term", "df", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def corpus_stats(spark, sf):
    return retrieval.corpus_stats(retrieval.weighted_terms(bind.chunks(spark, sf), [])).select("n", F.round("average_length", 6).alias("average_length"))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("question_id", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def _bm25(spark, sf, k=TOP_K, expand=False):
    return retrieval.bm25_search(_asked(spark, sf), bind.chunks(spark, sf), k, expand=expand)


def _asked(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query
def bm25_topk(spark, sf):
    return _shown(_bm25(spark, sf))


@query
def bm25_passages(spark, sf):
    """BM25 over the passages that the documents are cut into."""
    return _shown(retrieval.bm25_search(_asked(spark, sf), bind.passages(spark, sf), TOP_K))


@query
def bm25_expanded(spark, sf):
    return _shown(_bm25(spark, sf, 5, expand=True))


@query
def dense_topk(spark, sf):
    vectors = bind.unit_vectors(spark, sf)
    found = retrieval.dense_search(vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), vectors, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query
def rerank_topk(spark, sf):
    asked, chunks = _asked(spark, sf), bind.chunks(spark, sf)
    return _shown(retrieval.rerank(_bm25(spark, sf, 20), asked, chunks, top_k=5))


def _evaluated(spark, sf, reranked=False):
    """questions, ranked, judged, per-question metrics."""
    return _judged(spark, sf, bind.benchmark(spark, sf), _bm25(spark, sf, 20 if reranked else TOP_K), reranked)


def _judged(spark, sf, known, ranked, reranked=False):
    qrels, asked = known.judgements(), known.questions()
    if reranked:
        ranked = retrieval.rerank(ranked, asked, bind.chunks(spark, sf), top_k=TOP_K)
    ranked = ranked.filter(F.col("rank") <= TOP_K).select("question_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "doc_id", "score")
    ranked = written(ranked, "ranked")
    judged = metrics.judge(ranked, qrels, known.near_misses())
    return asked, ranked, judged, metrics.per_question(asked, judged, qrels, TOP_K)


@query
def qrel_flags(spark, sf):
    _, _, judged, _ = _evaluated(spark, sf)
    return judged.select("question_id", "rank", "chunk_id", "relevance", "is_gold_doc", "is_near_miss_doc")


@query
def predictions(spark, sf):
    """The nested records, their results as one text."""
    asked, _, judged, _ = _evaluated(spark, sf)
    shown = lambda r: F.concat_ws(" ", *[r[c].cast("string") for c in ("rank", "chunk_id", "doc_id", "relevance", "is_gold_doc", "is_near_miss_doc")])
    rows = metrics.predictions(asked, judged)
    return rows.select("question_id", "answerable", "topic", "question_type", "difficulty", F.array_join(F.transform("retrieved", shown), ", ").alias("retrieved"))


@query
def question_metrics(spark, sf):
    rows = _evaluated(spark, sf)[3]
    return rows.select("question_id", "answerable", F.round("reciprocal_rank", 6).alias("rr"), *[F.round(f"`{m}@{k}`", 6).alias(f"{m}_{k}") for k in (1, 3, 5, 10) for m in ("recall", "doc_recall", "ndcg", "near_miss_doc")])


@query
def metrics_by_slice(spark, sf):
    return metrics.answerable_metrics(_evaluated(spark, sf)[3], TOP_K)


@query
def unanswerable_metrics(spark, sf):
    return metrics.unanswerable_metrics(_evaluated(spark, sf)[3], TOP_K)


def _compared(spark, sf):
    known, wide = bind.benchmark(spark, sf), written(_bm25(spark, sf, 20), "ranked")
    left, right = _judged(spark, sf, known, wide), _judged(spark, sf, known, wide, reranked=True)
    return metrics.matched(left[3], right[3]), left[1], right[1]


@query
def compare_overall(spark, sf):
    rows = metrics.contingency(_compared(spark, sf)[0], TOP_K)
    return rows.select("k", "bucket", "n", F.array_join(F.col("question_ids").cast("array<string>"), ",").alias("ids"))


@query
def compare_by_slice(spark, sf):
    return metrics.contingency_by(_compared(spark, sf)[0], TOP_K)


@query
def compare_detail(spark, sf):
    return metrics.comparison_detail(*_compared(spark, sf))


@query
def validate_findings(spark, sf):
    return validation.validate(bind.benchmark_records(spark, sf), bind.chunks(spark, sf))


@query
def validate_summary(spark, sf):
    return validation.summary(bind.benchmark_records(spark, sf))


@query
def near_duplicate_pairs(spark, sf):
    return validation.near_duplicate_pairs(bind.question_copies(spark, sf))


@query
def near_duplicate_groups(spark, sf):
    return validation.near_duplicate_groups(_docs(spark, sf), "doc_id", "text")


@query
def gen_prompts(spark, sf):
    asked, chunks = _asked(spark, sf), bind.chunks(spark, sf)
    made = generation.evidence_prompts(asked, _bm25(spark, sf, 5), chunks)
    return made.select("question_id", F.char_length("input").cast("long").alias("n_chars"), F.md5("input").alias("digest"))


@query
def gen_dry_run(spark, sf):
    made = generation.generation_rows(generation.dry_run(_asked(spark, sf)), _asked(spark, sf), _bm25(spark, sf, 5), bind.chunks(spark, sf), "bm25_rag", dry=True)
    first = F.get("retrieved_chunks", F.lit(0))
    return made.select("question_id", "question", "abstained", "system", F.size("retrieved_chunks").cast("long").alias("n_retrieved"), first["chunk_id"].alias("top"), F.md5(first["text_preview"]).alias("preview_md5"))


def _stub() -> generation.KeywordModel:
    """A deterministic model: keywords are the question's words, more each round."""
    return generation.KeywordModel(
        lambda q, p: [*p, *q.split()[: len(p) + 2]],
        lambda q, c: {"answer": " ".join(c[:1]), "abstained": not c, "citations": c[:2]},
        lambda q, a: len(q) % 3 == 0 and bool(a["citations"]),
    )


@query
def iterkey_trace(spark, sf):
    """The loop around a stub model, two rounds, and its last answers."""
    asked = _asked(spark, sf)
    trace = generation.iterate_keywords(asked, bind.chunks(spark, sf), _stub(), max_iterations=2)
    rows = trace.select(
        "question_id", F.col("iteration").cast("int").alias("iteration"), F.array_join("keywords", "|").alias("keywords"), F.md5("expanded_query").alias("query_md5"),
        F.array_join("retrieved_chunk_ids", ",").alias("retrieved"), "answer", "abstained", F.array_join("citations", ",").alias("citations"), "is_supported",
    )
    last = generation.final_answers(asked, trace).select("question_id", F.col("answer").alias("final_answer"), F.coalesce("abstention_reason", F.lit("")).alias("reason"), F.array_join("citations", ",").alias("final_citations"))
    return rows.join(last, "question_id")


def _analysed(spark, sf):
    made = bind.generations(spark, sf)
    return evaluation.analyse(made.drop("answerable", "gold_chunk_ids", "question"), made.select("question_id", "answerable", "gold_chunk_ids"), bind.chunks(spark, sf))


@query
def citation_flags(spark, sf):
    rows = _analysed(spark, sf)
    joined = {c: F.array_join(c, ",") for c in ("missing_citations", "not_retrieved_citations")}
    return rows.withColumns(joined).withColumn("citation_count", F.col("citation_count").cast("long"))


@query
def heuristic_metrics(spark, sf):
    return evaluation.heuristic_metrics(_analysed(spark, sf))


@query
def review_template(spark, sf):
    made = bind.generations(spark, sf)
    rows = evaluation.review_template(made.drop("answerable", "gold_chunk_ids", "question"), made.select("question_id", "question", "answerable", "gold_chunk_ids"))
    return rows.select("question_id", "system", "answerable", F.md5("answer").alias("answer_md5"), F.array_join("gold_chunk_ids", ",").alias("gold"), "manual_correct", "review_hallucination_severity", "manual_notes")


@query
def reviewed_metrics(spark, sf):
    return evaluation.reviewed_metrics(bind.reviews(spark, sf))


@query
def flagged_rows(spark, sf):
    return evaluation.flagged_rows(bind.reviews(spark, sf))


@query
def label_findings(spark, sf):
    return validation.label_findings(bind.reviews(spark, sf))


@query
def issue_counts(spark, sf):
    return evaluation.issue_counts(bind.reviews(spark, sf))


@query
def explorer_filter(spark, sf):
    """Each filter alone and some together."""
    asked, reviews = written(bind.benchmark(spark, sf).questions(), "questions"), bind.reviews(spark, sf)
    settings = {
        "text": {"text": "THE"}, "id": {"text": "1"}, "medium": {"difficulty": "medium"}, "none": {"topic": "none"}, "answerable": {"answerable": True}, "issues": {"issues_only": True},
        "all": {"text": "an", "difficulty": "medium", "issues_only": True},
    }
    parts = [evaluation.explore(asked, reviews, **options).select(F.lit(name).alias("filter"), "question_id", F.md5("question").alias("question_md5")) for name, options in settings.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def facets(spark, sf):
    return evaluation.facets(bind.benchmark(spark, sf).questions())


@query
def system_summary(spark, sf):
    return evaluation.system_summary(evaluation.reviewed_metrics(bind.reviews(spark, sf)))


@query
def shown_answers(spark, sf):
    made = bind.generations(spark, sf)
    text = evaluation.shown_answer(F.when(~F.col("abstained"), F.col("answer")), F.when(F.col("system") != "non_rag", F.lit("abstained")))
    return made.select("question_id", F.md5(text).alias("shown_md5"))


@query
def missing_fields(spark, sf):
    return validation.missing_fields(bind.question_lines(spark, sf))


@query
def not_boolean(spark, sf):
    return validation.not_boolean(bind.question_lines(spark, sf))


def _refused(check: Callable[[], object]) -> bool:
    try:
        check()
    except ValueError:
        return True
    return False


@query
def gates(spark, sf):
    """Which inputs stop a run: a benchmark with errors, labels that are missing, no reviews."""
    found, reviews = validation.validate(bind.benchmark_records(spark, sf), bind.chunks(spark, sf)), bind.reviews(spark, sf)
    rows = [
        ("benchmark with errors", _refused(lambda: validation.gate(found))), ("benchmark with warnings", _refused(lambda: validation.gate(found.filter("severity = 'warning'")))),
        ("missing labels", _refused(lambda: validation.label_gate(reviews))), ("no reviews", _refused(lambda: evaluation.reviewed_metrics(reviews.limit(0)))),
    ]
    return spark.createDataFrame(rows, "input string, refused boolean")


@query
def open_prompts(spark, sf):
    _, text = generation.open_prompt()
    return _asked(spark, sf).select("question_id", F.md5(text).alias("digest"))


@query
def retriever_descriptions(spark, sf):
    """The search with and without expansion as it describes itself."""
    chunks = bind.chunks(spark, sf)
    rows = [retrieval.build_retriever("bm25", chunks, expand=x).describe() for x in (False, True)]
    made = [(r["name"], r["num_chunks"], r["k1"], r["b"], r["avg_indexed_doc_len"], r["query_expansion"]) for r in rows]
    return spark.createDataFrame(made, "name string, n long, k1 double, b double, average double, expanded boolean").withColumn("average", F.round("average", 6))


@query
def system_searches(spark, sf):
    """The search of each generation system."""
    chunks = bind.chunks(spark, sf)
    found = [(system, retrieval.system_retriever(system, chunks)) for system in generation.SYSTEMS]
    return spark.createDataFrame([(system, search.name if search else None) for system, search in found], "system string, search string")


@query
def embedding_cache(spark, sf):
    """Vectors as they come back from the cache; a cache of other chunks isn't used."""
    rows = bind.unit_vectors(spark, sf).select(F.col("vec_id").alias("position"), F.col("vec_id").cast("string").alias("chunk_id"), "vector")
    path = scratch_path(spark, "vectors")
    files.cache_embeddings(rows, path, "m", "s")
    got = files.cached_embeddings(spark, path, rows, "m", "s")
    other = files.cached_embeddings(spark, path, rows.filter("position > 0"), "m", "s") or files.cached_embeddings(spark, path, rows, "other", "s")
    return got.select("position", "chunk_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.lit(other is None).alias("others_refused"))


@query
def dashboard_questions(spark, sf):
    rows = evaluation.compact_questions(bind.benchmark_records(spark, sf))
    ids = {c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",") for c in ("gold_chunk_ids", "gold_doc_ids")}
    return rows.withColumns({**ids, "question": F.md5("question"), "gold_answer_short": F.md5("gold_answer_short")})


@query
def dashboard_reviews(spark, sf):
    rows = evaluation.compact_reviews(bind.full_reviews(spark, sf))
    shown = F.concat_ws("|", *[F.array_join(c, ",") if c in ("gold_chunk_ids", "citations", "retrieved_chunk_ids") else F.col(c).cast("string") for c in evaluation.REVIEW_COLUMNS[2:]])
    return rows.select("question_id", "system", F.md5(shown).alias("digest"))


@query
def dashboard_bundle(spark, sf):
    reviews = bind.full_reviews(spark, sf)
    rows = evaluation.bundle(reviews.select("question_id").distinct(), reviews)
    answers = F.transform(F.map_entries("reviews"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["model_answer"]))
    return rows.select("question_id", F.array_join(F.array_sort(answers), ",").alias("answers"))


@query
def question_detail(spark, sf):
    """The first question that a filter shows, with its reviews by system."""
    asked = bind.benchmark_records(spark, sf).filter("row = question_id and row > 0")
    shown = evaluation.explore(asked, bind.reviews(spark, sf), difficulty="hard")
    rows = evaluation.question_detail(asked, bind.full_reviews(spark, sf), shown)
    return rows.select("question_id", F.md5("question").alias("question_md5"), "answerable", F.md5("gold").alias("gold_md5"), "system", "position", "manual_correct")


@query
def date_stamps(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", (F.lit("2026-01-31 21:05:09").cast("timestamp") + F.make_dt_interval(hours=F.col("item_id") * 7)).alias("at"))
    value = F.when(F.col("item_id") % 5 == 0, "reviewed-results-snapshot").otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("item_id", tx.date_stamp(value).alias("shown"))


@query
def jsonl_round_trip(spark, sf):
    """Documents written as JSON lines and read again with a declared schema."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(_docs(spark, sf).select("doc_id", "text", "lang", "source"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, source string").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")
