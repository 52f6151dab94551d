"""Golden cases that the standard tables don't have."""

import pytest
from pyspark.sql import functions as F

from lumenqa.functions import cleaning
from lumenqa.functions import text as tx
from lumenqa.operators import chunking, evaluation, generation, metrics, retrieval, validation
from lumenqa.plans import bindings
from lumenqa.sources import files


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = apply(spark, tx.tokens, "The 2.1.3 don’t student's well-being a - b s's", "éanment THE", "the of a", "", None)
    assert got == [["2.1.3", "don't", "student", "well-being", "a-b", "s"], ["anment"], ["of"], [], []]


def test_headings(spark):
    lines = ["IV. Title", "Article 3", "part of the rules", "2.1 Scope", "A. Theft of", "A. One, two", "ALL CAPS HERE", "POLICY LIBRARY", "Volume: 4", "x" * 141, "plain text", "[Page 2]", ""]
    assert apply(spark, tx.is_section_heading, *lines) == [True, True, True, True, True, False, True, False, False, False, False, False, False]


def test_cleaning(spark):
    text = "A\xa0line – with  dash\n\nTable of Contents\n12\n\nwrapped line goes\non here\nIntro ........ 5\nVolume: 2\nstu- dent\n1. item\nth e end."
    assert apply(spark, cleaning.clean_pdf_text, text) == ["A line-with dash\n\nwrapped line goes on here\n\nstudent\n1. item the end."]  # an item goes on in the next line, as it has no end mark
    assert apply(spark, cleaning.clean_html_text, " a\t b \n\n\n c ") == ["a b\n\nc-"]


def test_keywords_and_preview(spark):
    rows = spark.createDataFrame([([" a  b ", "A B", "", "c", "C "],)], "k array<string>")
    assert rows.select(tx.clean_keywords(F.col("k")).alias("k")).first()["k"] == ["a b", "c"]
    assert apply(spark, lambda c: tx.tail_words(c, 2), "a b c", "a", "") == ["b c", "a", ""]


def chunk(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["section"], r["text"], r["word_count"]) for r in chunking.chunk_documents(df, **options).orderBy("chunk_index").collect()]


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n - 1)) + " end."


def test_chunk_overlap_crosses_a_section_after_a_full_passage(spark):
    one, two = words(60, "a"), words(55, "b")
    got = chunk(spark, f"SECTION ONE\n{one}\nSECTION TWO\n{two}", target=60, limit=80, overlap=5)
    assert got[0] == ("SECTION ONE", f"SECTION ONE\n\n{one}", 62)
    tail = " ".join(one.split()[-5:])
    assert got[1] == ("SECTION TWO", f"SECTION TWO\n\n{tail}\n\n{two}", 62)


def test_chunk_overflow_sections_and_front_matter(spark):
    a, b = words(50, "a"), words(50, "b")
    got = chunk(spark, f"{a}\n\n{b}\n\nHEAD LINE NOW\n{words(52, 'c')}\n[Page 3]\n\nNEXT HEAD LINE\nshort no sentence", target=90, limit=95, overlap=3)
    assert [g[0] for g in got] == [None, None, "HEAD LINE NOW"]
    assert got[1][1].startswith(" ".join(a.split()[-3:]) + "\n\n" + b.split()[0])
    assert got[2][1].startswith("HEAD LINE NOW\n\nc0")  # a section change takes the overlap away


def test_embedded_heading_and_long_sentence(spark):
    got = chunk(spark, f"K. Hazing {words(120, 'h')[:-1]}", target=60, limit=50, overlap=0)
    # The last 20 words hold no finished sentence and go as front matter.
    assert [g[2] for g in got] == [52, 52] and all(g[0] == "K. Hazing" for g in got)
    assert apply(spark, lambda c: chunking.split_block(c, 4), "One two. Three four five. Six.", "a b c d e f g h i. j.", "one") == [["One two.", "Three four five. Six."], ["a b c d", "e f g h", "i.", "j."], ["one"]]


def test_bm25_ties_and_empty(spark):
    chunks = spark.createDataFrame([(2, "2__0000", 0, "t", "en", None, "alpha beta"), (1, "1__0000", 0, "t", "en", None, "alpha beta"), (3, "3__0000", 0, "alpha", "en", None, "gamma")], "doc_id long, chunk_id string, chunk_index int, title string, topic string, section string, text string")
    asked = spark.createDataFrame([(1, "Alpha alpha?"), (2, "the of"), (3, "unknown")], "question_id long, question string")
    got = [(r["question_id"], r["rank"], r["doc_id"], r["matches"]) for r in retrieval.bm25_search(asked, chunks, 2).orderBy("question_id", "rank").collect()]
    assert got == [(1, 1, 3, 1), (1, 2, 1, 0)]
    with pytest.raises(ValueError):
        retrieval.rerank(chunks, asked, chunks, candidate_k=0)
    with pytest.raises(ValueError):
        retrieval.build_retriever("other", chunks)


def test_metrics(spark):
    asked = spark.createDataFrame([(1, True), (2, True), (3, False)], "question_id long, answerable boolean")
    ranked = spark.createDataFrame([(1, 1, "a", 1, 3.0), (1, 2, "b", 2, 2.0), (3, 1, "n", 9, 1.0)], "question_id long, rank int, chunk_id string, doc_id long, score double")
    qrels = spark.createDataFrame([(1, "b", 2, 3), (1, "c", 3, 2), (1, "a", 1, 1), (2, "z", 8, 3)], "question_id long, chunk_id string, doc_id long, relevance int")
    near = spark.createDataFrame([(3, 9)], "question_id long, doc_id long")
    rows = {r["question_id"]: r for r in metrics.per_question(asked, metrics.judge(ranked, qrels, near), qrels, 3).collect()}
    ideal = 7 / 1 + 3 / 1.584962500721156 + 1 / 2
    assert rows[1]["reciprocal_rank"] == 0.5 and rows[1]["recall@1"] == 0 and rows[1]["recall@3"] == 1
    assert abs(rows[1]["ndcg@3"] - (1 + 7 / 1.584962500721156) / ideal) < 1e-9
    assert rows[2]["reciprocal_rank"] == 0 and rows[2]["ndcg@3"] == 0 and rows[3]["near_miss_doc@1"] == 1
    assert metrics.k_values(4) == [1, 3, 4] and metrics.k_values(10) == [1, 3, 5, 10]


def test_missing_fields_tell_null_from_absent(spark):
    import json

    full = dict.fromkeys(validation.REQUIRED)
    rows = spark.createDataFrame([(json.dumps({**full, "question_id": "a"}),), (json.dumps({"question_id": "b", **{k: 1 for k in validation.REQUIRED if k not in ("notes", "qrels", "question_id")}}),)], "value string")
    got = [(r["question_id"], r["message"]) for r in validation.missing_fields(rows).collect()]
    assert got == [("b", "missing required fields: notes, qrels")]


def test_labels(spark):
    schema = "question_id long, system string, answerable boolean, abstained boolean, manual_correct boolean, manual_citation_supported boolean, manual_hallucinated boolean, review_abstention_correct boolean, review_hallucination_severity string"
    rows = spark.createDataFrame([(1, "s", True, False, None, None, None, None, None), (2, "s", False, True, True, True, False, None, "major"), (3, "s", False, False, False, True, True, True, "none")], schema)
    m = evaluation.reviewed_metrics(rows).first()
    assert (m["reviewed_correct_rate"], m["false_answer_rate"], m["num_citation_rows"]) == (0.333333, 0.5, 2)
    assert [r["question_id"] for r in evaluation.flagged_rows(rows).collect()] == [3]
    with pytest.raises(ValueError, match="missing"):
        validation.label_gate(rows)
    with pytest.raises(ValueError, match="invalid"):
        validation.label_gate(rows.filter("question_id = 3"))
    with pytest.raises(ValueError):
        evaluation.reviewed_metrics(rows.limit(0))


def test_generator_retries():
    calls, waits = [], []

    def call(instructions, text, temperature):
        calls.append(temperature)
        if len(calls) == 1:
            raise RuntimeError("unsupported temperature")
        if len(calls) == 2:
            raise RuntimeError("busy")
        return '{"answer": "x"}'

    assert generation.Generator(call, wait=waits.append)("i", "t") == {"answer": "x"}
    assert calls == [0.0, None, None] and waits == [2.0]


def test_keyword_loop(spark):
    chunks = spark.createDataFrame([(1, "1__0000", 0, "t", "en", None, "alpha"), (2, "2__0000", 0, "t", "en", None, "beta")], "doc_id long, chunk_id string, chunk_index int, title string, topic string, section string, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "nothing"), (3, "zzz")], "question_id long, question string")
    model = generation.KeywordModel(lambda q, p: [*p, "beta"] if q == "nothing" else [q], lambda q, c: {"answer": q, "abstained": q == "zzz", "citations": c}, lambda q, a: q == "alpha")
    trace = generation.iterate_keywords(asked, chunks, model, max_iterations=3)
    assert sorted((r["question_id"], r["iteration"]) for r in trace.collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    final = {r["question_id"]: r for r in generation.final_answers(asked, trace).collect()}
    assert not final[1]["abstained"] and final[2]["abstained"] and final[2]["citations"] == ["2__0000"] and final[3]["abstention_reason"] is None
    none = generation.final_answers(asked, generation.iterate_keywords(asked, chunks, model, max_iterations=0)).collect()
    assert all(r["abstained"] and r["citations"] == [] for r in none)


def test_sources(spark, tmp_path):
    rows = files.load_sources(spark, [{"doc_id": "a", "include": None, "date": 5}, {"doc_id": "b"}])
    assert [r["doc_id"] for r in files.included(rows).collect()] == ["b"]
    assert rows.filter("doc_id = 'a'").first()["extra"] == {"date": "5"}
    path = f"{tmp_path}/x"
    files.write_jsonl(spark.createDataFrame([(1, None, "é")], "b int, a string, c string"), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ['{"a":null,"b":1,"c":"é"}']
    assert files.reviewed_name("d/generations_s_review_template.jsonl") == "d/generations_s_reviewed_eval.json"
    with pytest.raises(ValueError):
        files.reviewed_name("other.jsonl")
    vectors = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "position int, chunk_id string, vector array<double>")
    assert files.cached_embeddings(spark, f"{tmp_path}/none", vectors, "m", "s") is None
    files.cache_embeddings(vectors, f"{tmp_path}/cache", "m", "s")
    assert files.cached_embeddings(spark, f"{tmp_path}/cache", vectors, "m", "s").count() == 2
    assert files.cached_embeddings(spark, f"{tmp_path}/cache", vectors.filter("position = 0"), "m", "s") is None


def test_page_text():
    page = "<body><nav>no</nav><main><h1>T <b>x</b></h1><p>a</p><ul><li>b<p>c</p></li></ul><script>z</script></main><p>out</p>"
    assert files.page_text(page) == "\nT x\n\na\n- b c\nc"
    assert files.page_text("<div>only <i>text</i></div>") == "only\ntext"


def test_page_text_of_deep_pages():
    n = 20_000
    assert files.page_text("<div>" * n + "<p>a</p>" + "</div>" * n) == "a"
    assert files.page_text("<div>x" * n).count("x") == n
    assert files.page_text("<li>a" * 300).count("- ") == 300
    assert files.page_text("<main><p>a</b></div>b</p></main>") == "a b"


def test_page_furniture(spark):
    own = cleaning.FURNITURE.of("Example", "example.org")
    text = "\n".join([
        "Example Policy Library", "Example University Policy 7.1, Part", "University Policy Office www.policy.example.org", "First line here. Example University Policy Office  policy.example.org",
        "Voluntary Leave of Absence for Students", "Library Volume: 4", "policy.example.org and more.", "POLICY 4.7", "Policy 7.2 Last Updated: today", "Last updated: now", "Kept to the end.",
    ])
    assert apply(spark, lambda c: cleaning.clean_pdf_text(c, own), text) == ["First line here.\nand more.\nKept to the end."]
    plain = apply(spark, cleaning.clean_pdf_text, text)[0]
    assert "Example Policy Library" in plain and "Voluntary Leave" not in plain and "POLICY 4.7" not in plain
    cut = f"Before. {cleaning.CUT_SENTENCES[0]} After."
    assert apply(spark, cleaning.clean_pdf_text, cut) == ["Before.  After."]


def test_wrapped_lines_by_brute_force(spark):
    """Against a loop over lines, with titles that a join makes or unmakes."""
    import random
    import re

    def title(line):
        letters = [c for c in line if c.isalpha()]
        named = re.match(r"(?i)(article|section|part)\s+\w+", line) or re.match(r"[IVXLCDM]+\.\s+.+", line)
        return len(line) <= 120 and bool(named or (letters and sum(map(str.isupper, letters)) / len(letters) > 0.75))

    def brute(lines):
        out = []
        for line in lines:
            last = out[-1] if out else ""
            apart = not last or not line or last.startswith("[Page ") or line.startswith("[Page ") or title(last) or title(line)
            if apart or re.match(r"(\d+\.|[a-zA-Z]\.|[ivxlcdmIVXLCDM]+\.)\s+", line) or re.search(r"[.?!:;)]$", last):
                out.append(line)
            else:
                out[-1] = f"{last} {line}"
        return out

    rng = random.Random(3)
    pool = ["", "words that go on", "and end here.", "TITLE LINE", "Part two", "[Page 3]", "1. item", "x", "AB c", "A BIG SHOUT and then quite small words", "iv. item (so)", "long " * 30 + "line"]
    rows = [(i, rng.choices(pool, k=rng.randint(1, 14))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, v array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", cleaning.merge_wrapped(F.col("v")).alias("x")).collect()}
    assert all(got[i] == brute(v) for i, v in rows)


def test_long_documents_take_time_in_proportion(spark):
    import time

    text = "\n".join(f"line {i} of words that go on" + (".\n" if i % 7 == 0 else "") for i in range(20_000))
    start = time.perf_counter()
    assert len(chunk(spark, text)) > 300
    assert len(apply(spark, cleaning.clean_pdf_text, text)[0]) > 400_000
    assert len(apply(spark, tx.tokens, "a-" * 50_000 + " " + "1.2." * 30_000)[0]) == 2
    assert time.perf_counter() - start < 60


def test_rows_that_share_an_id_are_cut_one_by_one(spark):
    df = spark.createDataFrame([(1, "one\n\ntwo\n\nthree"), (1, "uno\n\ndos\n\ntres"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["block_index"], r["block"]) for r in chunking.section_blocks(df).collect())
    assert got == [(0, "one"), (0, "uno"), (1, "dos"), (1, "two"), (2, "three"), (2, "tres")]


def test_strict_requests_and_replies(monkeypatch):
    seen = []

    def call(instructions, text, temperature, request):
        seen.append(request)
        return '{"answer": "x", "abstained": false, "abstention_reason": null, "citations": ["a"]}'

    made = generation.Generator(call, 0.5, model="m", schemas=True)("do", "this")
    assert made["citations"] == ["a"] and seen[0]["temperature"] == 0.5 and seen[0]["model"] == "m"
    form = seen[0]["text"]["format"]
    assert form["strict"] and form["type"] == "json_schema" and form["schema"]["additionalProperties"] is False and set(form["schema"]["required"]) == set(made)
    assert "temperature" not in generation.request("m", "i", "t", generation.ANSWER_SCHEMA)
    for bad in ('{"answer": "x"}', '{"answer": 1, "abstained": false, "abstention_reason": null, "citations": []}', '{"answer": "", "abstained": false, "abstention_reason": null, "citations": [1]}', "[]"):
        with pytest.raises(ValueError):
            generation.parse_reply(bad, generation.ANSWER_SCHEMA)
    monkeypatch.delenv("SOME_MODEL_KEY", raising=False)
    with pytest.raises(RuntimeError, match="SOME_MODEL_KEY"):
        generation.require_key("SOME_MODEL_KEY")
    monkeypatch.setenv("SOME_MODEL_KEY", "k")
    assert generation.require_key("SOME_MODEL_KEY") == "k"


def test_limit_takes_rows_as_they_come(spark):
    rows = spark.createDataFrame([("c",), ("a",), ("b",)], "question_id string").coalesce(1)
    assert [r[0] for r in generation.select_questions(rows, limit=2).collect()] == ["c", "a"]
    assert [r[0] for r in generation.select_questions(rows, limit=2, order="question_id").collect()] == ["a", "b"]


def test_last_grade_and_last_chunk_count(spark):
    qrels = spark.createDataFrame([(1, "a", 1, 3, 0), (1, "a", 1, 1, 1)], "question_id long, chunk_id string, doc_id long, relevance int, pos int")
    assert metrics.last_grades(qrels).first()["relevance"] == 1
    asked = spark.createDataFrame([("q", ["d"], ["c"], [("c", "d", "new")], [("c", "d", 9), ("z", "d", 9), ("c", "e", 3)])], "question_id string, gold_doc_ids array<string>, gold_chunk_ids array<string>, evidence array<struct<chunk_id:string,doc_id:string,quote:string>>, qrels array<struct<chunk_id:string,doc_id:string,relevance:int>>")
    chunks = spark.createDataFrame([("c", "d", "old text"), ("c", "d", "new text")], "chunk_id string, doc_id string, text string").coalesce(1)
    got = sorted((r["rule"], r["message"]) for r in validation.reference_rules(asked, chunks).collect())
    assert got == [("bad_grade", "qrels[0]: relevance must be one of [0, 1, 2, 3]"), ("other_doc", "qrels[2]: doc_id e does not match chunk c"), ("unknown_chunk", "qrels[1]: unknown chunk_id z")]


def test_dense_search_skips_what_has_no_score(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 1.0]), (5, [1.0, 0.0, 0.0])], "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (7, [0.0, 1.0])], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in retrieval.dense_search(asked.limit(1), vectors, 3).collect())
    assert got == [(7, 1, 1.0), (7, 4, 0.0)]
    assert retrieval.dense_search(asked.limit(0), vectors, 3).count() == 0


def test_question_detail(spark):
    asked = spark.createDataFrame([("a", "A?", True, "yes", None), ("b", "B?", False, None, "why")], "question_id string, question string, answerable boolean, gold_answer_short string, negative_rationale string")
    reviews = spark.createDataFrame([("b", "dense_rag", True), ("b", "non_rag", False), ("b", "unknown", False)], "question_id string, system string, manual_correct boolean")
    pick = lambda **options: sorted((r["question_id"], r["gold"], r["system"], r["position"]) for r in evaluation.question_detail(asked, reviews, **options).collect())
    assert pick(selected="b") == pick(shown=asked.filter("not answerable")) == [("b", "why", "dense_rag", 3), ("b", "why", "non_rag", 1)]
    assert pick() == pick(selected="zzz", shown=asked.limit(0)) == [("a", "yes", None, None)]


def test_terms_are_counted_without_a_shuffle(spark):
    chunks = spark.createDataFrame([(1, "1__0000", 0, "alpha", "en", "beta", "beta\nalpha gamma gamma don't"), (2, "2__0000", 0, None, None, None, None)], "doc_id long, chunk_id string, chunk_index int, title string, topic string, section string, text string")
    rows = retrieval.weighted_terms(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["length"], [tuple(t) for t in r["terms"]]) for r in rows.collect()}
    assert got == {1: (10, [("alpha", 3, True), ("beta", 3, True), ("don't", 1, False), ("en", 1, False), ("gamma", 2, False)]), 2: (0, [])}
    few = retrieval.weighted_terms(chunks, ["don't", "gamma"]).filter("doc_id = 1").first()
    assert few["length"] == 10 and [tuple(t) for t in few["terms"]] == [("don't", 1, False), ("gamma", 2, False)]


def test_bm25_by_cutoffs_equals_bm25_of_all(spark, monkeypatch):
    """With ties, a question of few matches, rows that share an id, and more copies than places."""
    import random

    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)]
    rows = [(i, f"{i}__0000", 0, rng.choice(pool), "en", None, " ".join(rng.choices(pool, weights=range(1, 41), k=rng.randint(1, 30)))) for i in range(600)]
    rows += [(600 + i, f"{600 + i}__0000", 0, "w1", "en", None, "w1 w2 w3 w4") for i in range(60)] + [(7, "7__0000", 0, "w0", "en", None, "w1 w2 w2"), (700, "700__0000", 0, "x", "en", None, "rare")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_index int, title string, topic string, section string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w39 w0"), (3, "rare w5"), (4, "rare"), (5, "none"), (2, "w39")], "question_id long, question string")
    found = lambda: sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"], r["matches"]) for r in retrieval.bm25_search(asked, chunks, 5).collect())
    whole = found()
    monkeypatch.setattr(retrieval, "SAMPLE", 60)
    monkeypatch.setattr(retrieval, "PART", 100)
    assert found() == whole and len(whole) == 16


def test_bm25_leaves_common_terms_for_last(spark, monkeypatch):
    """Whatever share of the cutoff they may have: common terms that decide a place, ties, and a question with too few matches for a cutoff."""
    rows = [(i, f"{i}__0000", 0, None, None, None, "common " * (i % 7) + "usual " * (i % 3) + (f"rare{i % 9}" if i % 5 else "")) for i in range(400)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_index int, title string, topic string, section string, text string")
    asked = spark.createDataFrame([(1, "common usual rare3"), (2, "common usual"), (3, "rare1 rare2 common"), (4, "common")], "question_id long, question string")
    found = lambda: sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"], r["matches"]) for r in retrieval.bm25_search(asked, chunks, 6).collect())
    whole = found()
    monkeypatch.setattr(retrieval, "SAMPLE", 40)
    monkeypatch.setattr(retrieval, "PART", 100)
    for share in (0.0, 0.5, 1.0):
        monkeypatch.setattr(retrieval, "LAST", share)
        assert found() == whole and len(whole) == 24


def test_ends_of_texts_are_read_alone(spark):
    """Words longer than expected, as many words as wanted and fewer, every kind of space; no pattern goes over the whole text to strip it."""
    texts = ["a b c d", "x" * 300 + " y z", "one", "", " ", "p\u2003q\x85r\xa0s\u3000", " ".join(map(str, range(300)))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.tail_words(F.col("t"), 3).alias("tail"), tx.strip(F.col("t")).alias("strip")).orderBy("i").collect()
    assert [r["tail"] for r in got] == [" ".join(t.split()[-3:]) for t in texts] and [r["strip"] for r in got] == [t.strip() for t in texts]
    assert "regexp_replace" not in str(tx.strip(F.col("t")))


def test_pages_are_read_in_small_pieces(spark):
    pages = spark.createDataFrame([(i, f"<p>page {i}</p>" if i % 3 else None) for i in range(700)], "page_id long, html string").coalesce(1)
    got = files.extract_pages(pages)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: f"page {i}" if i % 3 else "" for i in range(700)}


def test_dense_search_holds_few_scores_at_once():
    assert retrieval.QUERY_BLOCK * 10_000 * 8 <= 16 << 20  # of an Arrow batch of the default size


@pytest.mark.parametrize("made", [lambda ranked, asked, chunks: retrieval.rerank(ranked, asked, chunks, top_k=2), lambda ranked, asked, chunks: generation.evidence_prompts(asked, ranked, chunks), lambda ranked, asked, chunks: retrieval.with_text(ranked, chunks)])
def test_texts_of_ranked_rows_stay_where_they_are_read(spark, made, monkeypatch):
    """Few ranked rows are sent to the texts, no text is shuffled; the results are those of the shuffled join."""
    chunks = spark.createDataFrame([(i, f"{i}__0000", 0, "t", None, f"alpha beta {i}") for i in range(6)], "doc_id long, chunk_id string, chunk_index int, title string, section string, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta 3")], "question_id long, question string")
    ranked = spark.createDataFrame([(1, 1, "5__0000", 5, 0, 1.0), (2, 1, "4__0000", 4, 0, 1.0), (2, 2, "3__0000", 3, 0, 0.5)], "question_id long, rank int, chunk_id string, doc_id long, chunk_index int, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = made(ranked, asked, chunks)
        assert "hashpartitioning(chunk_id" not in df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(repr, df.collect()))
        monkeypatch.setattr(retrieval, "BROADCAST_RANKED", 1)
        assert got == sorted(map(repr, made(ranked, asked, chunks).collect())) and len(got) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_places_of_an_items_longest_word_are_hashed(spark, tmp_path, monkeypatch):
    """Judgements by the longest inner word and the two after it, the same by all words; quotes, backslashes and repeated words are in the items."""
    items = ["a b it's\\n \"quoted\" c d e", "one two three four", "short of it", "x  longestword\ty\nz w last", "same same same same same same"]
    texts = [f"left {items[0]} right", items[0][1:-1], "xa " + items[0] + "x", items[1], f"pre{items[2]}post", items[3], "x longestword y z w last", "same " * 9, "", None, items[3] + " " + items[4]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def gold():
        return sorted((r["question_id"], r["doc_id"]) for r in bindings.benchmark(spark, str(tmp_path)).facts.filter("role = 'gold'").collect())

    got = gold()
    assert got == [(q, d) for q, item in enumerate(items) for d, text in enumerate(texts) if text is not None and item in text]
    monkeypatch.setattr(bindings, "LITERAL_HEADS", 0)
    assert got == gold()
