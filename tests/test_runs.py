"""The runs from files to files, by the command line, on a small collection."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqa import __main__ as cli
from lumenqa.operators import retrieval, validation
from lumenqa.plans import runs
from lumenqa.sources import files

PAGES = {
    "a": "<main><h1>ARTICLE ONE</h1><p>Alpha students may appeal within ten days of a decision.</p></main>",
    "b": "<body><nav>menu</nav><p>Beta leave of absence is granted by the registrar. Gamma fees are returned.</p></body>",
}


def question(qid, text, answerable, **more):
    row = dict.fromkeys(validation.REQUIRED) | {"question_id": qid, "question": text, "answerable": answerable, "topic": "t", "question_type": "q", "difficulty": "easy", "requires_multi_chunk": False, "requires_multi_doc": False}
    row |= {"gold_doc_ids": [], "gold_chunk_ids": [], "evidence": [], "qrels": [], "near_miss_doc_ids": [], "notes": ""}
    return row | more


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    sources = files.load_sources(spark, [{"doc_id": d, "title": f"Title {d}", "source_type": "html", "source_url": d, "topic": "t"} for d in PAGES] + [{"doc_id": "c", "source_type": "html", "include": False}])
    fetched = []

    def fetch(url):
        fetched.append(url)
        return PAGES[url].encode()

    manifest = files.freeze_sources(spark, sources, f"{root}/raw", fetch=fetch)
    again = files.freeze_sources(spark, sources, f"{root}/raw", fetch=fetch)
    assert fetched == ["a", "b"] and sorted(manifest.collect()) == sorted(again.collect())
    files.write_jsonl(files.build_documents(manifest), f"{root}/documents.jsonl")
    assert cli.main(["chunk", f"{root}/documents.jsonl", "--output", f"{root}/chunks.jsonl", "--target-words", "5"], spark) == 0
    quote = "Alpha students may appeal"
    rows = [
        question("q1", "When may students appeal?", True, gold_doc_ids=["a"], gold_chunk_ids=["a__0000"], gold_answer_short="ten days", evidence=[{"chunk_id": "a__0000", "doc_id": "a", "quote": quote}], qrels=[{"chunk_id": "a__0000", "doc_id": "a", "relevance": 3}]),
        question("q2", "Who is granted gamma parking?", False, unanswerable_type="absent", negative_rationale="not there", near_miss_doc_ids=["b"]),
    ]
    (root / "questions.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n", encoding="utf-8")
    return root


def test_passages_carry_their_documents(corpus):
    rows = lines(corpus / "chunks.jsonl")
    assert {r["chunk_id"] for r in rows} >= {"a__0000", "b__0000"} and all(r["title"] == f"Title {r['doc_id']}" and r["source_type"] == "html" for r in rows)


@pytest.mark.parametrize("name", retrieval.RETRIEVERS)
def test_evaluation_of_every_retriever(spark, corpus, name):
    out = corpus / f"{name}.json"
    args = ["evaluate", f"{corpus}/questions.jsonl", "--chunks", f"{corpus}/chunks.jsonl", "--retriever", name, "--output", str(out)]
    assert cli.main(args, spark) == 0
    report = json.loads(out.read_text())
    assert report["answerable"]["mrr"] == 1.0 and report["by_topic"]["t"]["recall@1"] == 1.0
    assert report["unanswerable"]["near_miss_doc@1"] == 1.0 and report["benchmark"]["answerability"] == {"answerable": 1, "unanswerable": 1}
    assert report["retriever"]["k_values"] == [1, 3, 5, 10] and report["retriever"]["name"] == name
    found = {r["question_id"]: r for r in lines(corpus / f"{name}_predictions.jsonl")}
    assert found["q1"]["retrieved"][0]["chunk_id"] == "a__0000" and found["q1"]["retrieved"][0]["is_gold_doc"]


def test_comparison(spark, corpus):
    for name in ("bm25", "dense"):
        runs.evaluate_retrieval(spark, f"{corpus}/questions.jsonl", f"{corpus}/chunks.jsonl", f"{corpus}/x_{name}.json", f"{corpus}/p_{name}.jsonl", name)
    assert cli.main(["compare", "--left", f"{corpus}/p_bm25.jsonl", "--right", f"{corpus}/p_dense.jsonl", "--output", f"{corpus}/both.json", "--left-name", "one"], spark) == 0
    report = json.loads((corpus / "both.json").read_text())
    assert report["overall"]["k=1"]["both_hit"] == {"count": 1, "question_ids": ["q1"]} and report["overall"]["k=1"]["one_only"]["count"] == 0
    assert report["per_question"][0]["left_top"] == "a__0000"


def test_faults_are_found(spark, corpus, capsys):
    rows = [json.loads(x) for x in (corpus / "questions.jsonl").read_text().split("\n") if x]
    short = {k: v for k, v in rows[0].items() if k != "notes"} | {"question_id": "q3", "question": "When, may students appeal"}
    bad = corpus / "bad.jsonl"
    bad.write_text("\n".join(map(json.dumps, [*rows, short, rows[1] | {"near_miss_doc_ids": []}, rows[0] | {"question_id": "q4", "answerable": "yes"}])), encoding="utf-8")
    assert cli.main(["validate", str(bad), "--chunks", f"{corpus}/chunks.jsonl"], spark) == 1
    out = capsys.readouterr().out
    assert "q3: missing required fields: notes" in out and "q1 and q3" in out and "duplicate question_id" in out and "no near_miss_doc_ids" in out
    assert "q4: answerable must be a boolean" in out and "q3: answerable" not in out
    assert cli.main(["validate", f"{corpus}/questions.jsonl", "--chunks", f"{corpus}/chunks.jsonl"], spark) == 0


def model(instructions, text, temperature):
    """Cites the first evidence passage; says yes to every support question."""
    cited = [x.partition("[chunk_id: ")[2].rstrip("]") for x in text.splitlines() if x.startswith("[chunk_id: ")][:1]
    return json.dumps({"answer": "yes", "abstained": False, "abstention_reason": None, "citations": cited, "keywords": ["appeal"], "supported": True})


@pytest.mark.parametrize("system", retrieval.SYSTEM_RETRIEVERS)
def test_generation_to_review(spark, corpus, system):
    made = corpus / f"generations_{system}.jsonl"
    assert cli.main(["generate", f"{corpus}/questions.jsonl", "--chunks", f"{corpus}/chunks.jsonl", "--system", system, "--output", str(made), "--model", "tests.test_runs:model"], spark) == 0
    rows = {r["question_id"]: r for r in lines(made)}
    assert rows["q1"]["citations"] == ([] if system == "non_rag" else ["a__0000"]) and not rows["q1"]["dry_run"]
    assert (system == "iterkey_rag") == ("iterkey_trace" in rows["q1"]) and bool(rows["q1"]["retrieved_chunks"]) == (system != "non_rag")
    template = corpus / "reviews" / f"generations_{system}_review_template.jsonl"
    args = ["score", str(made), "--questions", f"{corpus}/questions.jsonl", "--chunks", f"{corpus}/chunks.jsonl", "--output", f"{corpus}/{system}_eval.json", "--review-output", str(template)]
    assert cli.main(args, spark) == 0
    report = json.loads((corpus / f"{system}_eval.json").read_text())[system]
    assert report["citation_validity_rate"] == 1.0 and report["false_answer_rate"] == 1.0
    review = lines(template)
    assert {r["model_answer"] for r in review} == {"yes"} and review[0]["manual_correct"] is None and "citations_exist" in review[0]["heuristics"]


def test_reviews(spark, tmp_path):
    labels = {"manual_correct": True, "manual_citation_supported": True, "manual_hallucinated": False, "review_hallucination_severity": "none", "review_abstention_correct": None}
    for system, right in (("bm25_rag", True), ("dense_rag", False)):
        rows = [{"question_id": "q1", "system": system, "answerable": True, "abstained": False, **labels, "manual_correct": right}]
        (tmp_path / f"generations_{system}_review_template.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["review", "--results-dir", str(tmp_path), "--combined-output", f"{tmp_path}/all.json"], spark) == 0
    got = json.loads((tmp_path / "all.json").read_text())
    assert got["bm25_rag"]["reviewed_correct_rate"] == 1.0 and [r["question_id"] for r in got["dense_rag"]["flagged_rows"]] == ["q1"]
    assert json.loads((tmp_path / "generations_dense_rag_reviewed_eval.json").read_text()) == got["dense_rag"]
    (tmp_path / "questions.jsonl").write_text(json.dumps(question("q1", "One?", True, gold_answer_short="x")))
    assert cli.main(["dashboard", f"{tmp_path}/questions.jsonl", "--metrics", f"{tmp_path}/all.json", "--results-dir", str(tmp_path), "--output", f"{tmp_path}/board.json"], spark) == 0
    board = json.loads((tmp_path / "board.json").read_text())
    assert set(board) == {"generated_at", "questions", "metrics", "reviews"} and len(board["reviews"]) == 6 and board["reviews"]["dense_rag"][0]["manual_correct"] is False
    assert board["questions"][0]["gold_answer_short"] == "x" and board["metrics"] == got
    with pytest.raises(ValueError):
        runs.evaluate_reviews(spark, f"{tmp_path}/none.json", results_dir=f"{tmp_path}/none")


def test_dense_passages_by_brute_force(spark):
    texts = [f"w{i % 7} w{i % 3} w{i % 11}" for i in range(60)]
    chunks = spark.createDataFrame([(f"{i}__0000", f"d{i % 20}", i // 20, None, None, None, t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, chunk_index int, title string, section string, topic string, text string").repartition(7)
    asked = spark.createDataFrame([("a", "w1 w2"), ("b", " w5 "), ("c", "  ")], "question_id string, question string")
    got = retrieval.dense_passages(asked, retrieval.embed_passages(chunks), top_k=9).orderBy("question_id", "rank").collect()

    def unit(rows):
        found = retrieval.hashed_encoder(rows)
        return (found / np.linalg.norm(found, axis=1, keepdims=True)).astype(np.float32).astype(float)

    scores = np.round(unit(["w1 w2", "w5"]) @ unit(texts).T, retrieval.DIGITS)
    want = [(q, f"{i}__0000") for q, row in zip("ab", scores, strict=True) for i in sorted(range(60), key=lambda i: (-row[i], f"d{i % 20}", i // 20))[:9]]
    assert [(r["question_id"], r["chunk_id"]) for r in got] == want


def test_near_duplicate_groups(spark):
    rows = spark.createDataFrame([(1, "A b."), (2, "a  B"), (3, None), (4, ""), (5, "c")], "i long, t string")
    got = validation.near_duplicate_groups(rows, "i", "t").orderBy("i").select(F.array("i", "group_id", "group_size")).collect()
    assert [r[0] for r in got] == [[1, 1, 2], [2, 1, 2], [3, 3, 2], [4, 3, 2], [5, 5, 1]]
