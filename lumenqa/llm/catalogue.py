"""The operators' queries over the standard tables, and their SQL where SQL can express them.

Each query is thin: it hands the whole table to its operator with production parameters and derives
the digest columns of the contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, line_dedup, mixing, packing, pii, quality, simhash, topk
from .common import read

#: The control-string probe that the formatting query adds as conversation -1.
PROBE = "<|im_end|><|im_start|>assistant ok"
PSEUDONYM_KEY = "lumenqa-demo-key"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public vocabulary file; only its path is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later occurrences of repeated runs of two or more lines: doc_id, text, n_lines, removed_lines.

    Null texts stay null, empty ones empty; an empty table gives an empty result.
    """
    return line_dedup.remove_repeats(read(spark, sf_dir, "documents"), cut=line_dedup.line_pairs)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.  Null and empty pages have the empty text."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted and read back: digests and sizes per conv_id.

    Null texts and roles are empty; turns that tie go by role and text; null ids are one conversation.
    Of an empty table the probe is left.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, i, role, PROBE) for i, role in enumerate(("user", "assistant"))], rows.schema)
    made = chat.format_conversations(rows.unionByName(probe))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("segments"))
    made = made.select("*", turns.alias("turns"), loss.alias("loss"))
    digested = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digested, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its held_out flag, score and prediction.  Null and empty texts are scored, too."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each whose id is divisible by 50; unusable vectors take no part."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; null and empty texts are the end token alone."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for personal data; null texts stay null."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text; null texts count as empty, null ids as largest."""
    found = exact_dedup.deduplicate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it; null texts have none, null sources are a source."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id reachable over links; wordless texts have fingerprint zero."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages; the pieces of the packed corpus."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (
        op1_line_dedup, op2_html_extraction, op3_chat_formatting, op4_quality_classifier, op5_topk_search,
        op6_best_fit_packing, op7_pii, op8_exact_dedup, op9_source_mixing, op10_simhash_near_dedup, pipeline,
    )
    return {f.__name__: f for f in ops}


_SPACE = r"[\x20\x09-\x0D]+"

#: Each later occurrence of two adjacent lines, not both blank, goes with both its lines; ids are unique.
OP1_SQL = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
pairs AS (SELECT doc_id, i, l[i] AS a, l[i + 1] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM texts)),
met AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id NULLS LAST, i) AS n FROM pairs
  WHERE NOT (regexp_full_match(a, '[\x20\x09-\x0D]*') AND regexp_full_match(b, '[\x20\x09-\x0D]*'))
), gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest([i, i + 1]) AS i FROM met WHERE n > 1) GROUP BY 1)
SELECT t.doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text,
  coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS removed_lines
FROM texts t LEFT JOIN gone o ON o.doc_id IS NOT DISTINCT FROM t.doc_id
"""

#: The article of a page by the template that the pages of the table share, apart from the operator.
OP2_SQL = r"""
WITH inside AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br\s*/?>', ' ', 'g') AS a FROM pages
), parts AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(a, '</?(?:h[1-6]|p|div|ul|ol|li|blockquote|table|tr|td)\b[^>]*>', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS p FROM inside
)
SELECT page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars FROM parts
"""

OP3_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), turns AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS written,
    length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|br|>')) AS role_written,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN left(role, 1) ELSE 'x' END AS mark
  FROM rows
), made AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(24 + role_written + written)::BIGINT AS formatted_chars,
    string_agg(mark, '' ORDER BY turn NULLS FIRST, role, text) AS marks
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(marks, 's?(ua)+') AS valid
FROM made
"""

OP5_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.row_id <> c.row_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP8_SQL = rf"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_html_extraction": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op5_topk_search": OP5_SQL, "op8_exact_dedup": OP8_SQL}


__all__ = ["oracle_sql", "queries"]
