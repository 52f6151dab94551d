"""Mixing, packing, quality, search and the pipeline against brute force, and the registered queries."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqa.llm import catalogue, mixing, packing, quality, topk
from lumenqa.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def brute_shares(sizes, weights, total, cap=2.0):
    """By bisection on the common level."""
    low, high = 0.0, sum(sizes) * 100.0 + 1
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_shares_and_rounds(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        sizes = [rng.choice([0, 5, 100, 1000, 50_000]) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        got, want = mixing.shares(sizes, weights, 1.5 * sum(sizes)), brute_shares(sizes, weights, 1.5 * sum(sizes))
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-3) for a, b in zip(got, want, strict=True))
        df = spark.createDataFrame([(str(i), s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double")
        rounds = {r["source"]: r["target"] for r in mixing.share_rounds(df, 1.5, 2.0).collect()}
        assert all(math.isclose(rounds[str(i)], x, rel_tol=1e-9, abs_tol=1e-6) for i, x in enumerate(got))


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(2)
    sizes = [rng.randint(0, 500) for _ in range(60)] + [7] * 20
    mean = np.zeros(len(sizes))
    for seed in range(300):
        p = [0.3] * len(sizes)
        mixing.flight(p, sizes, random.Random(seed))
        assert sum(0 < x < 1 for x in p) <= 2
        assert math.isclose(sum(p), 0.3 * len(sizes), rel_tol=1e-6)
        assert math.isclose(sum(a * b for a, b in zip(p, sizes, strict=True)), 0.3 * sum(sizes), rel_tol=1e-6)
        mean += p
    assert abs(mean / 300 - 0.3).max() < 0.12  # probabilities are kept on average


def docs(spark, rows):
    return spark.createDataFrame([(*r, 3, 1.0) for r in rows], "doc_id long, text string, source string, size long, target double")


def test_mix_edges(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 5000, None), (None, "q", "t"), (5, "a b", "t"), (5, "a b", "t"), (6, "ü\x0bv\x85w", "é")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted([("1", 3), ("2", 0), ("3", 0), ("4", 5000), ("None", 1), ("5", 2), ("5", 2), ("6", 2)])
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.apply_mix(docs(spark, [])).count() == 0
    applied = mixing.apply_mix(docs(spark, rows[:5]))
    assert applied.columns == ["doc_id", "text", "source", "size", "target"]


def test_apply_mix_with_repeated_and_null_ids(spark):
    """Each source meets its own target where rows of all sources share an id or have none."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["w"] * (3 + i % 5)), "abc"[i * i % 7 % 3]) for i in range(300)]
    made = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, times int")
    size = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in {r[2] for r in rows}}
    target = {r["source_size"]: r["target"] for r in mixing.mix(made).collect()}
    got = mixing.apply_mix(made.repartition(3)).collect()
    taken, each = Counter(), Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
        each[(r["doc_id"], r["text"], r["source"])] += 1
    assert len(set(size.values())) == len(size)
    for s, n in size.items():
        assert abs(taken[s] - target[n]) <= 7, (s, taken[s], target[n])
    assert set(each) <= {tuple(r) for r in rows}


def test_mix_query(spark):
    out = catalogue.op9_source_mixing(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    sums, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in out:
        s = source[r["doc_id"]]
        sums[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(sums)
    want = brute_shares([sums[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sums.values()))
    for s, w in zip(names, want, strict=True):
        assert math.isclose(target[s], w, rel_tol=1e-6)
        assert abs(taken[s] - w) <= largest[s]
    again = catalogue.op9_source_mixing(spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"max_attention": 1200}])
def test_plan_is_valid_and_tight(rule, limits):
    rng = random.Random(3)
    histogram = Counter(rng.choice([40, 17, *range(1, 33)]) for _ in range(3000))
    histogram = {k: v for k, v in histogram.items() if k * k <= limits.get("max_attention", 1 << 30)}
    bins, numbers = defaultdict(list), Counter()
    for length, number, each, first, many, offset in packing.plan(dict(histogram), 64, rule=rule, **limits).tolist():
        assert number == numbers[length]
        numbers[length] += each * many
        for s, k in itertools.product(range(first, first + many), range(each)):
            bins[s].append((offset + k * length, length))
    assert all(numbers[k] == v for k, v in histogram.items()) or numbers == Counter(histogram)
    for items in bins.values():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(items)) and items[0][0] == 0
        assert sum(n for _, n in items) <= 64 and len(items) <= limits.get("max_docs", 64)
        assert sum(n * n for _, n in items) <= limits.get("max_attention", 64 * 64)
    if not limits:
        assert len(bins) <= math.ceil(sum(k * v for k, v in histogram.items()) / 64) * 1.02 + 1


def test_packing_query(spark):
    from tokenizers import Tokenizer

    out = catalogue.op6_best_fit_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = Tokenizer.from_file(catalogue.tokenizer_path())
    by, places, total = defaultdict(list), defaultdict(list), 0
    for r in out:
        by[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        got = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for items in places.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(items)) and sum(n for _, n in items) <= 4096
    assert len(places) <= math.ceil(total / 4096) + 1


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "x", "don't ÀÉ 12ª ''s", "a\x1cb\x85c", "日本 and 😀 İ", "<|endoftext|> as text", "word " * 9000, "x", "é"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(2, "x", "s"), (None, "y", "s")])
    packed = packing.pack(df, catalogue.tokenizer_path(), with_ids=True)
    tok = Tokenizer.from_file(catalogue.tokenizer_path())
    got = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += r["ids"]
    for i, t in enumerate(texts):
        assert got[i] == [*tok.encode(t or "", add_special_tokens=False).ids, 1] * (2 if i == 2 else 1), t
    rows = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(map(len, got.values())) and all(sum(r["lengths"]) == len(r["ids"]) <= 4096 for r in rows)
    assert packing.pack(df.limit(0), catalogue.tokenizer_path()).count() == 0


def test_factorisation_identity_and_fit():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    index, value = np.array([3, 9, 70, 100]), np.array([0.5, 1.0, -2.0, 0.1])
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i, j in itertools.combinations(range(4), 2))
    assert math.isclose(m.raw(index, value, np.array([0]))[0][0], 0.3 + m.linear[index] @ value + pairs, rel_tol=1e-9)
    # label = whether two words meet: no linear machine learns this
    rows = [quality.features(f"{a} {b}", None) for a, b in itertools.product(("aa", "bb"), ("xx", "yy")) for _ in range(60)]
    labels = np.array([float((a == "aa") == (b == "xx")) for a, b in itertools.product(("aa", "bb"), ("xx", "yy")) for _ in range(60)])
    fitted = quality.fit(rows, labels, epochs=60)
    index = [fitted.scores(i, v, np.array([0]))[0] for i, v in rows]
    assert ((np.array(index) > 0.5) == labels).mean() == 1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in catalogue.op4_quality_classifier(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    marks = [(r["quality"], out[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    good, bad = [r["score"] for q, r in marks if q == 1], [r["score"] for q, r in marks if q == 0]
    assert np.mean([a > b for a, b in itertools.product(good, bad)]) > 0.97
    assert np.mean([r["predicted"] == q for q, r in marks]) > 0.95 and all(0 <= r["score"] <= 1 for r in out.values())


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, "good words here", 15, 1), (2, None, None, 1), (None, "", 0, 1), (3, "x" * 300_000, 5, 1), (3, " \n\t", -4, 1)], "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    out = quality.classify(df, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(df, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).columns == df.columns


def brute_topk(rows, k):
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(x)) for x in v]

    valid = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    out = []
    for n, (q, own) in enumerate(valid):  # every row but the query's own is a candidate
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for m, (i, v) in enumerate(valid) if m != n and len(v) == len(own))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(s[:k], 1)]
    return out


def test_topk_reads_fewer_entries_than_there_are():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20_000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
    q, other = v[:40], np.ones((40, 20_000), bool)
    other[np.arange(40), np.arange(40)] = False
    scores = np.where(other, q @ v.T, -np.inf)
    seen = topk.gathered(q, v[::16], np.arange(0, 20_000, 16), other[:, ::16], 5, 4)
    cutoff = np.array([np.sort(s)[-5] for _, s in seen])
    assert (cutoff <= np.sort(scores, axis=1)[:, -5]).all()  # safe
    i, j, found, read = topk.sufficient(q, v, cutoff, other, 4)
    want = np.argwhere(scores >= cutoff[:, None])
    assert sorted(zip(i, j, strict=True)) == sorted(map(tuple, want)) and (found == scores[i, j]).all()
    assert read + 4 * 40 * 1250 < 0.95 * 4 * 40 * 20_000


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_topk_brute_force(spark, lists, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = random.Random(lists)
    f32 = lambda: float(np.float32(rng.uniform(-1, 1)))
    rows = [(i, [f32() for _ in range(7)]) for i in range(400)]
    rows += [(i, rows[i % 10][1]) for i in range(400, 480)]  # ties
    rows += [(500, None), (550, [1.0, None] + [0.0] * 5), (501, [float("nan")] * 7), (502, [float("inf")] + [0.0] * 6), (600, [0.5, 0.5]), (650, []), (651, []), (601, [1.0, 1.0]), (None, rows[0][1]), (3, rows[3][1]), (50, rows[7][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5, lists=lists).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(rows, 5))
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_big_components(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e9, -1.0]), (2, [2e9, 0.0]), (3, [1.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    top = (1 << 63) - 1
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, min(top, 256**2 * 3 * 10**9 * 2 * 10**9)), (1, min(top, 256**2 * (6 * 10**18) - 256**2))] or len(got) == 2


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    path = scratch_path(spark, "test")
    for n, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{path}/{n}")
        docs = spark.read.parquet(f"{path}/{n}")
        ids.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
        if n < 4:
            assert docs.columns == columns
            assert set(ids[-1]) <= set(ids[-2])
    verdict = {r["doc_id"]: r["predicted"] for r in catalogue.op4_quality_classifier(spark, SF).collect()}
    assert set(ids[1]) == {i for i, p in verdict.items() if p}
    assert max(ids[2].values()) == max(ids[3].values()) == 1
    pieces = {(r["doc_id"], r["piece"]) for r in docs.select("doc_id", "piece").collect()}
    assert Counter(i for i, p in pieces if p == 0).keys() == ids[4].keys()
    assert sum(1 for r in docs.collect() if r["piece"] == 0) == sum(ids[4].values())
    assert sorted((r["doc_id"], r["piece"]) for r in cp.run(spark, SF).collect()) == sorted((r["doc_id"], r["piece"]) for r in docs.collect())


EDGES = [
    (1, "alpha beta gamma delta", "s", 3.0), (1, "alpha beta gamma delta", "s", 3.0), (1, "quite another text under this id", "s", 0.0), (2, None, None, None), (3, "", "t", 1.0),
    (None, "no id here but words", "t", 1.0), (None, "no id here but words", "t", 1.0), (None, None, None, None), (4, "word " * 30_000, "s", 2.0), (5, "ALPHA beta gamma delta", "u", 2.0), (6, " \n\t ", None, 1.0),
]


@pytest.mark.parametrize("rows", [EDGES, []])
def test_pipeline_edges(spark, tmp_path, rows):
    """Null and repeated ids, empty and long texts, repeated rows, empty tables and a column with a dot."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), x) for i, t, s, x in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` double")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (3, 0, 0), (3, 0, 0)][: 4 if rows else 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [sorted(map(str, got.collect()))]
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/out-{n}")
        got = spark.read.parquet(f"{tmp_path}/out-{n}")
        if n < 4:
            assert got.columns == docs.columns
            seen.append(sorted(map(str, got.collect())))
            assert set(seen[-1]) <= set(seen[-2])
    if not rows:
        assert got.count() == 0 and cp.run(spark, str(tmp_path)).count() == 0
        return
    norm = lambda r: " ".join((r["text"] or "").split(" "))
    kept = spark.read.parquet(f"{tmp_path}/out-1").collect()
    assert len({norm(r) for r in kept}) == len(kept)
    near = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out-2").collect()}
    assert (1, "quite another text under this id") in near and (5, "ALPHA beta gamma delta") not in near
    pieces, last = got.collect(), spark.read.parquet(f"{tmp_path}/out-3").collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(last)
    assert cp.run(spark, str(tmp_path)).count() == len(pieces)


def test_packing_numbers_and_training_bounds(spark):
    """Pieces of a length are numbered without gaps; training stops at its bounds."""
    items = spark.createDataFrame([(i, 5 + i % 3) for i in range(900)], "row_id long, length long")
    got = defaultdict(list)
    for r in packing.numbered(items, 300).collect():
        got[r["length"]].append(r["number"])
    assert all(sorted(v) == list(range(300)) for v in got.values()) and len(got) == 3
    df = docs(spark, [(i, f"{'good' if i % 2 else 'bad'} words {i}", "s") for i in range(60)]).withColumn("n_chars", F.lit(12).cast("long"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.training_rows(df, labels, 10).count() == 10
    few = quality.train(df, labels, 40, max_bytes=1)  # not one row fits: the prior
    assert few.bias == 0 and not few.linear.any()
    ids = [5, 6, 9, 100, 101, 7, 7, 5000]
    assert quality._ranges(ids, 3) == [(5, 9), (100, 101), (5000, 5000)] and quality._ranges(ids, 1) == [(5, 5000)] and len(quality._ranges(ids)) == 7 - 0
    words = df.select(F.concat(F.lit("id"), F.col("doc_id")).alias("doc_id"), "text", "n_chars")
    assert quality.training_rows(words, labels.select(F.concat(F.lit("id"), F.col("doc_id")).alias("doc_id"), "quality"), 10).count() == 10


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lumenqa.llm import common

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_root(session(master))
        assert common.shared_root(session(master, "hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    assert common.shared_root(session("local[4]")).startswith("file:")
