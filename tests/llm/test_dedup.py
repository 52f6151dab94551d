"""Exact, near and line dedup against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenqa.llm import exact_dedup, line_dedup, simhash
from lumenqa.llm.components import connected_components

DOCS = "doc_id long, text string, kept string, digest int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def brute_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


MIXED = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, None), (7, ""), (8, " "), (None, "a b"), (None, "z"), (11, " a b"), (12, "x" * 200_000), (2, "x" * 200_000)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1).substr(1, 0)) if weak else exact_dedup.sha256
    got = exact_dedup.deduplicate(table(spark, MIXED).repartition(3), digest=digest).collect()
    want = brute_groups(MIXED)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == sorted((str(a), str(b), n) for a, b, n, _ in want)
    assert sum(r["kept"] for r in got) == len({d for *_, d in want})
    if not weak:
        assert sorted(r["digest"] for r in got) == sorted(d for *_, d in want)


def test_exact_repeated_rows_keep_one(spark):
    rows = [(1, "t"), (1, "t"), (2, "t"), (1, "u"), (None, "n"), (None, "n")]
    got = exact_dedup.deduplicate(table(spark, rows)).filter("kept").select("doc_id", "keep_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 1), (1, 1), (None, None)]))
    left = exact_dedup.keep_first(table(spark, rows))
    assert left.columns == ["doc_id", "text", "kept", "digest"]
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(map(str, [(1, "t"), (1, "u"), (None, "n")]))


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (exact_dedup.deduplicate, exact_dedup.keep_first, simhash.near_duplicates, simhash.keep_representatives, line_dedup.remove_repeats):
        assert f(empty).count() == 0


def test_runs_can_be_looked_up(spark):
    runs = exact_dedup.flush_runs(table(spark, MIXED), "doc_id", "text", exact_dedup.sha256, "test-runs")
    assert {r["doc_id"] for r in exact_dedup.lookup(runs, [hashlib.sha256(b"a b").hexdigest()]).collect()} == {5, 3, None}


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    marks = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def test_fingerprint():
    rng = random.Random(3)
    texts = [None, "", "  \t", "One", "Ünder Two\x0bthree", "a b c d", "\x85x  y z"] + [" ".join(rng.choices("ab BC ñ D".split(), k=k)) for k in (3, 4, 50, 700)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket_rows", [2, 32])
def test_links_cover_all_close_pairs(spark, bucket_rows):
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(4)]
    marks = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(30)} | {0, 1, (1 << 64) - 1, 3}
    marks |= {rng.getrandbits(64) for _ in range(50)}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df, "test", bucket_rows=bucket_rows).collect()]
    close = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert components(signed, got) == components(signed, close)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in got)


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in enumerate(range(10, 290, 20), 100)]
    rows += [(1, " ".join(f"q{rng.randint(0, 9999)}" for _ in range(200))), (50, None), (40, " \n"), (None, "only one"), (60, "Only\tONE"), (100, rows[0][1])]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    marks = [brute_fingerprint(t) for _, t in rows]
    nodes = range(len(rows))
    root = components(list(nodes), [(a, b) for a, b in combinations(nodes, 2) if (marks[a] ^ marks[b]).bit_count() <= 2])
    want = []
    for n in nodes:
        ids = [rows[m][0] for m in nodes if root[m] == root[n] and rows[m][0] is not None]
        want.append((rows[n][0], f"{marks[n]:016x}", min(ids) if ids else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = simhash.keep_representatives(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "digest"]
    assert {r["doc_id"] for r in kept.collect()} == {w[2] for w in want if w[0] == w[2]} | {None}


def test_representatives_of_repeated_ids(spark):
    """A near copy under an id takes no other text under it along, and each component keeps one row."""
    own = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, own("a")), (5, own("a").upper()), (5, own("b")), (7, own("c")), (7, own("c")), (7, own("d")), (8, own("d").upper()), (9, own("e")), (None, own("a"))]
    got = simhash.keep_representatives(table(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "text", "kept", "digest"]
    want = [(1, own("a")), (5, own("b")), (7, own("c")), (7, own("d")), (9, own("e")), (None, own("a"))]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links, "test").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}


def brute_line_dedup(rows):
    """Chunks by local minima of the rolling hash, from the operator's own definition."""
    sign = lambda x: x - (1 << 64) if x >> 63 else x

    def spark_long(value, seed):  # XXH64 of a long, as the engine's xxhash64 continues a row
        return xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)

    def cut(text):
        lines = text.split("\n")
        h = [sign(xxhash.xxh64_intdigest(line.encode(), 42)) for line in lines]
        r = [sign(spark_long(h[i + 1] if i + 1 < len(h) else 0, spark_long(h[i], 42))) for i in range(len(h))]
        low, at, out = -(1 << 63), 0, []
        for i in range(len(r)):
            if i == len(r) - 1 or (r[i] < (r[i - 1] if i else low) and r[i] <= r[i + 1]):
                out.append((at, i + 1))
                at = i + 1
        return lines, [(a, b) for a, b in out if b - a > 1]

    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        if rows[k][1] is None:
            continue
        lines, spans = cut(rows[k][1])
        for a, b in spans:
            if seen.setdefault("\n".join(lines[a:b]), (k, a)) != (k, a):
                gone.setdefault(k, set()).update(range(a, b))
    return [(i, None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(k, ()))) for k, (i, t) in enumerate(rows)]


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randint(3, 9)))
    passage = [line() for _ in range(14)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 5))] + passage * (i % 3 > 0) + [line() for _ in range(rng.randint(1, 5))])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "one line"), (104, "one line"), (105, "\n".join(passage))]
    got = line_dedup.remove_repeats(table(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "text", "n_lines", "removed_lines"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, brute_line_dedup(rows)))
    changed = got.filter("removed_lines > 0").count()
    assert changed >= 18  # most copies of the passage lose its inner chunks
    assert got.filter("doc_id in (100, 101, 103, 104) and removed_lines > 0").count() == 0


def test_line_boundaries_resist_shifts(spark):
    rng = random.Random(4)
    passage = [f"line {rng.random()}" for _ in range(40)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["new first line", *passage]))]
    chunks = line_dedup.chunked(table(spark, rows), "doc_id", "text").collect()
    one, two = ({r["chunk"] for r in chunks if r["doc_id"] == i} for i in (1, 2))
    assert len(one & two) >= len(one) - 2


def test_every_repeated_run_goes(spark, tmp_path):
    """op1 against brute force over runs of two or more lines: any length, at any place of a text."""
    from lumenqa.llm import catalogue

    rng = random.Random(6)
    line = lambda: f"line {rng.random()}"
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 5, 9)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 3))] + passages[i % 6] + [line() for _ in range(rng.randint(0, 3))])) for i in range(36)]
    rows += [(50, "a\na\na\na"), (51, "a\na"), (52, "x\n\n\ny"), (53, "z\n\n\nw"), (54, None), (55, "q"), (56, "q"), (None, "\n".join(passages[2]))]
    rows += [(60, "\n".join(passages[3])), (61, passages[0][0] + "\nalone\n" + passages[0][1])]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(pair):
                gone |= {k, k + 1} if pair in seen else set()
                seen.add(pair)
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    table(spark, rows).select("doc_id", "text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.op1_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["removed_lines"]) for r in got))) == sorted(map(str, want))
    assert sum(n for *_, n in want) >= 30 * 2
    assert {x[0]: x[1] for x in want}[53] == "z\n\n\nw"


def test_stages_with_clashing_columns(spark):
    """Extra columns named like the helpers of a stage stay as they are and change no decision."""
    import corpus_pipeline
    from lumenqa.llm import mixing, quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    names = "label other digest kept_id row_id size times fp component_id __id __key __digest __gone __copy __times __rows __row".split()
    more = docs.select("*", *[F.lit(n).alias(n) for n in names])
    stages = (lambda d: quality.keep_good(d, labels), exact_dedup.keep_first, simhash.keep_representatives, mixing.apply_mix)
    assert len(stages) == len(corpus_pipeline.STAGES) - 1
    for stage in stages:
        got = stage(more)
        assert got.columns == more.columns
        assert got.filter(" or ".join(f"not `{n}` <=> '{n}'" for n in names)).isEmpty()
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in stage(docs).select("doc_id").collect())


def test_index_takes_batches(spark):
    """Batches added one by one give the entries of one load; levels of like size are merged."""
    rng = random.Random(9)
    rows = [(i, f"text {rng.randint(0, 60)}") for i in range(300)] + [(None, "text 3"), (None, None), (2, "text 3")]
    rng.shuffle(rows)
    index = exact_dedup.Index(spark, "test-index")
    sizes = []
    for a in range(0, len(rows), 50):
        batch = table(spark, rows[a : a + 50])
        known = {r["digest"] for r in index.known(exact_dedup.flush_runs(batch, "doc_id", "text", exact_dedup.sha256, "test-index")).collect()}
        before = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows[:a]}
        assert known == before & {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows[a : a + 50]}
        index.add(batch)
        sizes.append(len(index.levels))
    assert max(sizes) < exact_dedup.FAN_IN and min(sizes[3:]) < 3  # merged
    got = {r["digest"]: (r["first"]["doc_id"], r["group_size"]) for r in index.entries().collect()}
    assert got == {d: (k, n) for _, k, n, d in brute_groups(rows)}


def test_filter_loses_nothing(spark):
    have = spark.range(0, 3000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    found = exact_dedup.Filter.of(have, 3000, "test-filter")
    asked = spark.range(0, 30_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = {r["id"] for r in found.probe(asked).filter("maybe").collect()}
    assert got >= set(range(3000)) and len(got) < 3000 + 27_000 * 0.1


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from lumenqa.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k int, v int")
    counts = rows.filter("k < 300").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.col("n") * 2)
    got = common.join_by_key(rows, counts, ["k"], 600)
    assert got.columns == ["k", "v", "m"]
    n = Counter(0 if i % 3 else i for i in range(600))
    want = [(k, i, 2 * n[k]) for i in range(600) if (k := 0 if i % 3 else i) < 300]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    left = {(r["k"], r["v"]): r["m"] for r in common.join_by_key(rows, counts, ["k"], 600, how="left").collect()}
    assert len(left) == 601 and left[(None, -1)] is None and left[(0, 1)] == 2 * n[0] and left[(597, 597)] is None


def test_line_dedup_with_one_hash_for_all(spark, monkeypatch):
    """Chunks that share a hash are told apart by their bytes."""
    rows = [(1, "a\nb\nc"), (2, "x\na\nb"), (3, "c\nd"), (4, "a\nb"), (None, "c\nd")]

    def weak(lines, texts):
        made = line_dedup.line_pairs(lines, True)
        return F.transform(made, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.lit(7).cast("long").alias("hash"), *[c["chunk"].alias("chunk")] * texts))

    got = {str(r["doc_id"]): r["text"] for r in line_dedup.remove_repeats(table(spark, rows), cut=weak).collect()}
    assert got == {"1": "a\nb\nc", "2": "x", "3": "c\nd", "4": "", "None": ""}


def test_long_texts_take_time_in_proportion(spark):
    import time

    def took(n):
        df = table(spark, [(1, "\n".join(f"line {i}" for i in range(n)))])
        start = time.perf_counter()
        assert line_dedup.remove_repeats(df, cut=line_dedup.line_pairs).first()["n_lines"] == n
        return time.perf_counter() - start

    took(1000)
    assert took(64_000) < 4 * took(4_000) + 10  # 16 times the lines; in proportion to their square it was minutes
