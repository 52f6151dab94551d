"""DuckDB SQL for the registered queries, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions.cleaning import CUT_SENTENCES, REPAIRS, REPEATED_LINES, REPEATED_PATTERNS, REPEATED_STARTS
from ..functions.text import EXPANSIONS, METADATA_PREFIXES, STOPWORDS
from ..operators.generation import SYSTEMS
from ..operators.retrieval import SYSTEM_RETRIEVERS
from ..operators.validation import REQUIRED

Q = "'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return ", ".join(_q(x) for x in items)


def fold(x: str) -> str:
    return rf"lower(regexp_replace(translate({x}, '’‘“”–—', '''''\"\"--'), '\s+-\s+', '-', 'g'))".replace('\\"', '"')


def tokens(x: str, stop: bool = True) -> str:
    found = rf"regexp_extract_all({fold(f'coalesce({x}, {Q}{Q})')}, '\d+(?:\.\d+)+|[a-z0-9]+(?:[''-][a-z0-9]+)*')"
    found = f"list_transform({found}, lambda w: CASE WHEN length(w) > 2 AND ends_with(w, '''s') THEN left(w, length(w) - 2) ELSE w END)"
    return f"list_filter({found}, lambda w: w NOT IN ({_list(STOPWORDS)}))" if stop else found


def expanded(x: str) -> str:
    return f"concat_ws(' ', {x}, " + ", ".join(f"CASE WHEN contains({fold(x)}, {_q(p)}) THEN {_q(' '.join(t))} END" for p, t in EXPANSIONS.items()) + ")"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def upper_share(x: str) -> str:
    return rf"(length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')), 0))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


METADATA = "(" + " OR ".join(f"starts_with(line, {_q(p)})" for p in METADATA_PREFIXES) + ")"
LETTERED = rf"(regexp_matches(line, '^[A-Z]\.\s+[A-Z][A-Za-z]') AND NOT regexp_matches(line, '-$|[,;]') AND {words('line')} <= 8)"
HEADING = rf"""(NOT (line = '' OR length(line) > 140 OR starts_with(line, '[Page ') OR line IN ('POLICY LIBRARY', 'MOST CURRENT VERSION OF THIS POLICY') OR {METADATA})
  AND (regexp_matches(line, '^(#{{1,4}}\s+)?[IVXLCDM]+\.\s+\S+') OR regexp_matches(line, '(?i)^(Article|Section|Part)\s+[A-Z0-9IVXLCDM]+')
  OR (regexp_matches(line, '^\d+(?:\.\d+)+\s+[A-Z][A-Za-z]') AND {words('line')} <= 14) OR {LETTERED}
  OR (length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 4 AND coalesce({upper_share('line')} > 0.75, false) AND {words('line')} <= 14)))"""
TITLE = rf"(length(line) <= 120 AND (regexp_matches(line, '(?i)^(Article|Section|Part)\s+\w+') OR regexp_matches(line, '^[IVXLCDM]+\.\s+.+') OR coalesce({upper_share('line')} > 0.75, false)))"
CONTENTS = r"(line IN ('Table of Contents', 'CONTENTS', 'INDEX') OR regexp_matches(line, '(\.{5,}|_{5,})\s*\d+') OR (length(line) > 20 AND (length(line) - length(translate(line, '._', '')))::DOUBLE / length(line) > 0.25))"
SYSTEM = "[" + _list(SYSTEMS) + "]"


def chunk_id(x: str) -> str:
    return f"(({x})::BIGINT::VARCHAR || '__0000')"


ENTRIES = rf"""entries AS (
  SELECT chunk_id, doc_id, chunk_index, {tokens('title')} AS tt, {tokens('section')} AS st, {tokens('topic')} AS pt,
    {tokens("CASE WHEN section <> '' AND starts_with(text, section) THEN substr(text, length(section) + 1) ELSE text END")} AS bt
  FROM chunks
), weighted AS (
  SELECT *, (2 * len(tt) + 3 * len(st) + len(pt) + len(bt))::BIGINT AS length FROM entries
), term_rows AS (
  SELECT chunk_id, doc_id, chunk_index, length, unnest(tt) AS term, 2 AS weight, true AS named FROM weighted
  UNION ALL SELECT chunk_id, doc_id, chunk_index, length, unnest(st), 3, true FROM weighted
  UNION ALL SELECT chunk_id, doc_id, chunk_index, length, unnest(pt), 1, false FROM weighted
  UNION ALL SELECT chunk_id, doc_id, chunk_index, length, unnest(bt), 1, false FROM weighted
), postings AS (
  SELECT chunk_id, doc_id, chunk_index, length, term, sum(weight)::BIGINT AS tf, bool_or(named) AS named FROM term_rows GROUP BY ALL
), stats AS (SELECT count(*)::BIGINT AS n, coalesce(avg(length), 0.0) AS average_length FROM weighted),
frequent AS (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term)"""
ONE_CHUNK = rf"""chunks AS (
  SELECT doc_id, {chunk_id('doc_id')} AS chunk_id, 0 AS chunk_index, source AS title, lang AS topic,
    CASE WHEN contains(text, chr(10)) AND {words("split_part(text, chr(10), 1)")} <= 14 THEN split_part(text, chr(10), 1) END AS section, text
  FROM documents
)"""
CHUNKS = f"{ONE_CHUNK}, {ENTRIES}"
#: The passages of documents as chunks; their table comes before.
PASSAGE_CHUNKS = """chunks AS (
  SELECT doc_id, printf('%d__%04d', doc_id, chunk_index) AS chunk_id, chunk_index, source AS title, lang AS topic, x.section AS section, x.text AS text FROM passages JOIN documents USING (doc_id)
)"""

ASKED = "asked AS (SELECT item_id AS question_id, text AS question FROM benchmark)"


def ranked(k: int, name: str = "ranked", expand: bool = False, asked: str = "asked") -> str:
    return f"""{name}_terms AS (SELECT question_id, unnest(list_distinct({tokens(expanded('question') if expand else 'question')})) AS term FROM {asked}),
{name}_scores AS (
  SELECT question_id, chunk_id, doc_id, chunk_index, count_if(named) AS matches,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.35 + 0.65 * length / average_length))), 9) AS score
  FROM {name}_terms JOIN frequent USING (term) JOIN postings USING (term) CROSS JOIN stats GROUP BY ALL
), {name} AS (
  SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, matches DESC, doc_id, chunk_index))::INT AS rank, chunk_id, doc_id, chunk_index, score
  FROM {name}_scores QUALIFY rank <= {k}
)"""


def reranked(base: str, k: int, name: str = "again") -> str:
    """The stand-in scorer: the share of the question's words in title, section and text."""
    split = lambda x: rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"
    text = "concat_ws(chr(10) || chr(10), nullif(c.title, ''), nullif(c.section, ''), nullif(c.text, ''))"
    return f"""{name}_scores AS (
  SELECT b.question_id, b.chunk_id, b.doc_id, b.chunk_index, b.rank AS base_rank,
    round(len(list_intersect({split('a.question')}, {split(text)}))::DOUBLE / greatest(1, len({split('a.question')})), 9) AS score
  FROM {base} b JOIN asked a USING (question_id) JOIN chunks c ON b.chunk_id = c.chunk_id
), {name} AS (
  SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, base_rank, doc_id, chunk_index))::INT AS rank, chunk_id, doc_id, score
  FROM {name}_scores QUALIFY rank <= {k}
)"""


QRELS = f"""gold AS (SELECT item_id AS question_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
qrels AS (
  SELECT question_id, doc_id, {chunk_id('doc_id')} AS chunk_id, 3 AS relevance FROM gold
  UNION ALL SELECT DISTINCT question_id, doc_id + 1, {chunk_id('doc_id + 1')}, 1 FROM gold g
  WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = g.doc_id + 1) AND NOT EXISTS (SELECT 1 FROM gold h WHERE h.question_id = g.question_id AND h.doc_id = g.doc_id + 1)
), questions AS (
  SELECT item_id AS question_id, b.text AS question, t.topic IS NOT NULL AS answerable,
    coalesce(t.topic, 'none') AS topic, 't' || (item_id % 3) AS question_type,
    CASE WHEN length(b.text) < 150 THEN 'easy' WHEN length(b.text) < 250 THEN 'medium' ELSE 'hard' END AS difficulty
  FROM benchmark b LEFT JOIN (SELECT question_id, arg_min(lang, doc_id) AS topic FROM gold JOIN documents USING (doc_id) GROUP BY 1) t ON t.question_id = b.item_id
), step AS (SELECT greatest(40, ceil((max(doc_id) + 1) / 25.0))::BIGINT AS step FROM documents),
near AS (SELECT question_id, doc_id FROM questions CROSS JOIN step JOIN documents ON doc_id % step = question_id % 40 WHERE NOT answerable)"""


def judged(base: str, name: str = "judged") -> str:
    return f"""{name} AS (
  SELECT r.question_id, r.rank, r.chunk_id, r.doc_id, r.score, coalesce(q.relevance, 0) AS relevance,
    EXISTS (SELECT 1 FROM gold g WHERE g.question_id = r.question_id AND g.doc_id = r.doc_id) AS is_gold_doc,
    EXISTS (SELECT 1 FROM near n WHERE n.question_id = r.question_id AND n.doc_id = r.doc_id) AS is_near_miss_doc
  FROM {base} r LEFT JOIN qrels q ON q.question_id = r.question_id AND q.chunk_id = r.chunk_id
)"""


KS = (1, 3, 5, 10)


def per_question(base: str = "judged", name: str = "scored") -> str:
    parts, outs = [], []
    for k in KS:
        parts += [
            f"max((rank <= {k} AND relevance >= 3)::INT) AS recall_{k}", f"max((rank <= {k} AND is_gold_doc)::INT) AS doc_recall_{k}",
            f"max((rank <= {k} AND is_near_miss_doc)::INT) AS near_miss_doc_{k}", f"sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= {k}) AS dcg_{k}",
        ]
        outs += [f"coalesce({m}_{k}, 0)::DOUBLE AS {m}_{k}" for m in ("recall", "doc_recall", "near_miss_doc")]
        outs.append(f"coalesce(dcg_{k} / nullif(ideal_{k}, 0), 0) AS ndcg_{k}")
    ideal = ", ".join(f"sum((pow(2, relevance) - 1) / log2(place + 1)) FILTER (place <= {k}) AS ideal_{k}" for k in KS)
    return f"""{name} AS (
  SELECT q.*, coalesce(1.0 / first_rank, 0.0) AS rr, first_rank, top_score, {', '.join(outs)}
  FROM questions q
  LEFT JOIN (SELECT question_id, min(rank) FILTER (relevance >= 3) AS first_rank, max(score) FILTER (rank = 1) AS top_score, {', '.join(parts)} FROM {base} GROUP BY 1) g USING (question_id)
  LEFT JOIN (SELECT question_id, {ideal} FROM (SELECT question_id, relevance, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC) AS place FROM qrels) GROUP BY 1) i USING (question_id)
)"""


EVALUATED = f"WITH {CHUNKS}, {ASKED}, {ranked(10)}, {QRELS}, {judged('ranked')}, {per_question()}"
COMPARED = f"""WITH {CHUNKS}, {ASKED}, {ranked(10)}, {ranked(20, 'wide')}, {reranked('wide', 10)}, {QRELS}, {judged('ranked')}, {per_question()},
{judged('again', 'judged2')}, {per_question('judged2', 'scored2')},
both_sides AS (SELECT l.*, {', '.join(f'r.recall_{k} AS r_{k}' for k in KS)}, r.first_rank AS r_first_rank FROM scored l JOIN scored2 r USING (question_id) WHERE l.answerable)"""
BUCKET = "CASE WHEN l > 0 AND r > 0 THEN 'both_hit' WHEN l > 0 THEN 'left_only' WHEN r > 0 THEN 'right_only' ELSE 'both_miss' END"
CASES = "cases AS (" + " UNION ALL ".join(f"SELECT question_id, topic, question_type, difficulty, {k} AS k, recall_{k} AS l, r_{k} AS r FROM both_sides" for k in KS) + ")"

_one, _two = chunk_id("(conv_id * 7 + turn) % 1100"), chunk_id("(conv_id * 3) % 1000")
GENERATIONS = f"""gens AS (
  SELECT a.conv_id || '-' || a.turn AS question_id, {SYSTEM}[a.conv_id % 6 + 1] AS system, u.text AS question, a.text AS answer, length(a.text) < 300 AS abstained,
    CASE WHEN length(a.text) < 300 OR a.conv_id % 6 = 0 THEN []::VARCHAR[] ELSE [{_one.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')}, {_two.replace('conv_id', 'a.conv_id')}] END AS citations,
    CASE WHEN a.conv_id % 6 = 0 THEN []::VARCHAR[] ELSE [{_one.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')}, {chunk_id('(a.conv_id * 3 + a.conv_id % 2) % 1000')}] END AS retrieved,
    a.conv_id % 4 <> 0 AS answerable, [{_two.replace('conv_id', 'a.conv_id')}] AS gold
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'
), flags AS (
  SELECT question_id, system, answerable, abstained, NOT abstained AS answered, len(citations)::BIGINT AS citation_count,
    list_filter(citations, lambda c: NOT list_contains(ids, c)) AS missing,
    CASE WHEN len(retrieved) > 0 THEN list_filter(citations, lambda c: NOT list_contains(retrieved, c)) ELSE [] END AS outside,
    list_has_any(citations, gold) AS has_gold_citation, trim(answer) <> '' AS answer_nonempty, answer, gold
  FROM gens CROSS JOIN (SELECT list({chunk_id('doc_id')}) AS ids FROM documents)
)"""
REVIEWS = f"""revs AS (
  SELECT doc_id AS question_id, {SYSTEM}[doc_id % 6 + 1] AS system, doc_id % 4 <> 0 AS answerable, n_chars < 500 AS abstained,
    CASE WHEN doc_id % 11 <> 0 THEN quality = 1 END AS manual_correct, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS manual_citation_supported,
    toxic = 1 AS manual_hallucinated, CASE WHEN doc_id % 8 = 0 THEN toxic <> 1 END AS review_abstention_correct,
    CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'major' WHEN toxic = 1 THEN 'minor' WHEN doc_id % 13 = 0 THEN 'minor' ELSE 'none' END AS severity
  FROM labels JOIN documents USING (doc_id)
)"""
ISSUE = "(manual_correct IS FALSE OR manual_citation_supported IS FALSE OR manual_hallucinated IS TRUE OR review_abstention_correct IS FALSE)"


def rate(flag: str, where: str = "true") -> str:
    return f"round(coalesce(avg(coalesce({flag}, false)::INT) FILTER ({where}), 0.0), 6)"


REVIEWED = f"""reviewed AS (
  SELECT system, count(*) AS num_reviewed, {rate('manual_correct')} AS reviewed_correct_rate, {rate('manual_hallucinated')} AS reviewed_hallucination_rate,
    {rate("severity = 'major'")} AS major_hallucination_rate, count_if(answerable)::BIGINT AS num_answerable, {rate('manual_correct', 'answerable')} AS answerable_accuracy,
    {rate('manual_hallucinated', 'answerable')} AS answerable_hallucination_rate, {rate('abstained', 'answerable')} AS over_abstention_rate,
    count_if(NOT answerable)::BIGINT AS num_unanswerable, {rate('review_abstention_correct', 'NOT answerable')} AS correct_refusal_rate,
    {rate('NOT coalesce(review_abstention_correct, false)', 'NOT answerable')} AS false_answer_rate, {rate('manual_hallucinated', 'NOT answerable')} AS unanswerable_hallucination_rate,
    count(manual_citation_supported) AS num_citation_rows, {rate('manual_citation_supported', 'manual_citation_supported IS NOT NULL')} AS citation_support_rate
  FROM revs GROUP BY system
)"""

RECORDS = f"""WITH {QRELS}, records AS (
  SELECT q.*, list_concat(coalesce(j.gold_docs, []), CASE WHEN q.question_id % 8 = 0 THEN [-7] ELSE [] END) AS gold_docs,
    list_concat(coalesce(j.gold_chunks, []), CASE WHEN q.question_id % 7 = 0 THEN ['missing__0000'] ELSE [] END) AS gold_chunks,
    CASE WHEN answerable AND q.question_id % 5 <> 0 THEN question END AS gold_answer, coalesce(j.n_gold, 0) AS n_gold,
    CASE WHEN NOT answerable AND q.question_id % 3 <> 0 THEN 'absent' END AS unanswerable_type, CASE WHEN NOT answerable OR q.question_id % 9 = 0 THEN 'why' END AS rationale,
    coalesce(n.near_miss, 0) AS near_miss, coalesce(j.n_all, 0) AS n_all
  FROM questions q
  LEFT JOIN (SELECT question_id, list(doc_id) FILTER (relevance = 3) AS gold_docs, list(chunk_id) FILTER (relevance = 3) AS gold_chunks, count_if(relevance = 3) AS n_gold, count(*) AS n_all FROM qrels GROUP BY 1) j USING (question_id)
  LEFT JOIN (SELECT question_id, count(*) AS near_miss FROM near GROUP BY 1) n USING (question_id)
), graded AS (
  SELECT q.question_id, r.chunk_id, r.doc_id, r.relevance, row_number() OVER (PARTITION BY q.question_id ORDER BY r.chunk_id, r.doc_id, r.relevance) - 1 AS i, d.text, question
  FROM questions q JOIN qrels r USING (question_id) JOIN documents d USING (doc_id)
), evidence AS (
  SELECT question_id, text, row_number() OVER (PARTITION BY question_id ORDER BY chunk_id) - 1 AS i, CASE WHEN question_id % 4 = 0 THEN 'not in the text' WHEN question_id % 11 <> 0 THEN question END AS quote
  FROM graded WHERE relevance = 3
), odd AS (
  SELECT question_id, chunk_id, (SELECT n_all FROM records r WHERE r.question_id = g.question_id) + (question_id % 6 = 0)::INT AS i FROM graded g WHERE i = 0 AND question_id % 10 = 0
), copies AS (
  SELECT question_id AS row, question_id, question_id AS of, question FROM questions
  UNION ALL SELECT question_id + 1000000, question_id, question_id, question FROM questions WHERE question_id % 17 = 0
  UNION ALL SELECT question_id + 2000000, question_id + 100000, question_id, upper(question) || ' ?' FROM questions WHERE question_id % 13 = 0
)"""


def _rule(severity: str, name: str, where: str, message: str, source: str = "records") -> str:
    return f"SELECT question_id AS of, '{severity}' AS severity, '{name}' AS rule, {message} AS message FROM {source} WHERE {where}"


def folded(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


FOLDED = folded("text")
PAIRS = f"""SELECT a.question_id AS first_id, b.question_id AS second_id
  FROM (SELECT row, question_id, {folded('question')} AS key FROM copies) a JOIN (SELECT row, question_id, {folded('question')} AS key FROM copies) b ON a.key = b.key AND a.row < b.row"""
SINGLE = [
    _rule("error", "no_gold_docs", "answerable AND len(gold_docs) = 0", "'answerable question has no gold_doc_ids'"),
    _rule("error", "no_gold_chunks", "answerable AND len(gold_chunks) = 0", "'answerable question has no gold_chunk_ids'"),
    _rule("error", "no_gold_answer", "answerable AND coalesce(gold_answer, '') = ''", "'answerable question has no gold_answer_short'"),
    _rule("error", "no_relevant_qrel", "answerable AND n_gold = 0", "'answerable question needs at least one relevance=3 qrel'"),
    _rule("error", "has_unanswerable_type", "answerable AND unanswerable_type IS NOT NULL", "'answerable question should have null unanswerable_type'"),
    _rule("error", "has_rationale", "answerable AND rationale IS NOT NULL", "'answerable question should have null negative_rationale'"),
    _rule("error", "has_gold", "NOT answerable AND len(gold_chunks) + len(gold_docs) > 0", "'unanswerable question should not have gold ids'"),
    _rule("error", "has_gold_answer", "NOT answerable AND gold_answer IS NOT NULL", "'unanswerable question should have null gold_answer_short'"),
    _rule("error", "has_evidence", "NOT answerable AND n_gold > 0", "'unanswerable question should not have evidence'"),
    _rule("error", "has_relevant_qrel", "NOT answerable AND n_gold > 0", "'unanswerable question cannot have relevance=3 qrel'"),
    _rule("error", "no_unanswerable_type", "NOT answerable AND coalesce(unanswerable_type, '') = ''", "'unanswerable question needs unanswerable_type'"),
    _rule("error", "no_rationale", "NOT answerable AND coalesce(rationale, '') = ''", "'unanswerable question needs negative_rationale'"),
    _rule("warning", "no_near_miss", "NOT answerable AND near_miss = 0", "'unanswerable question has no near_miss_doc_ids'"),
    _rule("error", "unknown_gold_doc", "question_id % 8 = 0", "'unknown gold_doc_id -7'"),
    _rule("error", "unknown_gold_chunk", "question_id % 7 = 0", "'unknown gold_chunk_id missing__0000'"),
    # Of a chunk that is not there nothing more is said, though its grade is unknown, too.
    _rule("error", "unknown_chunk", "question_id % 6 = 0", "'qrels[' || n_all || ']: unknown chunk_id missing__0000'"),
    _rule("error", "other_doc", "true", "'qrels[' || i || ']: doc_id -6 does not match chunk ' || chunk_id", "odd"),
    _rule("error", "bad_grade", "true", "'qrels[' || i || ']: relevance must be one of [0, 1, 2, 3]'", "odd"),
    _rule("error", "no_quote", "coalesce(quote, '') = ''", "'evidence[' || i || ']: missing quote'", "evidence"),
    _rule("error", "quote_not_found", "quote <> '' AND NOT contains(text, quote)", "'evidence[' || i || ']: quote not found in chunk text'", "evidence"),
]
FINDINGS = (
    RECORDS + ", single AS (" + " UNION ALL ".join(SINGLE) + f"), pairs AS ({PAIRS}) "
    + "SELECT c.question_id::VARCHAR AS question_id, severity, rule, message FROM single JOIN copies c USING (of) "
    + "UNION ALL SELECT NULL, 'error', 'duplicate_id', 'duplicate question_id values: ' || string_agg(id, ', ' ORDER BY id) FROM (SELECT question_id::VARCHAR AS id FROM copies GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 "
    + "UNION ALL SELECT first_id::VARCHAR, 'warning', 'near_duplicate', 'near-duplicate normalized question text: ' || first_id || ' and ' || second_id FROM pairs"
)

_METRICS = ["mrr", *[f"{m}@{k}" for k in KS for m in ("recall", "doc_recall", "ndcg")]]
SLICES = (
    EVALUATED
    + ", sliced AS ("
    + " UNION ALL ".join(f"SELECT {_q(s)} AS slice, {c} AS grp, * FROM scored WHERE answerable" for s, c in (("all", "'all'"), ("topic", "topic"), ("question_type", "question_type"), ("difficulty", "difficulty")))
    + ") "
    + " UNION ALL ".join(
        ["SELECT slice, grp AS \"group\", 'num_questions' AS metric, count(*)::DOUBLE AS value FROM sliced GROUP BY ALL"]
        + [f"SELECT slice, grp, {_q(m)}, round(avg({'rr' if m == 'mrr' else m.replace('@', '_')}), 6) FROM sliced GROUP BY ALL" for m in _METRICS]
    )
)
UNANSWERABLE = (
    EVALUATED
    + ", u AS (SELECT * FROM scored WHERE NOT answerable) "
    + " UNION ALL ".join(
        f"SELECT {_q(n)} AS metric, {e} AS value FROM u HAVING count(*) > 0"
        for n, e in [
            ("num_questions", "count(*)::DOUBLE"), ("avg_top_score", "round(coalesce(avg(top_score), 0.0), 6)"), ("max_top_score", "round(coalesce(max(top_score), 0.0), 6)"),
            *[(f"near_miss_doc@{k}", f"round(avg(near_miss_doc_{k}), 6)") for k in KS],
        ]
    )
)
PREVIEW = lambda x: rf"substr({strip(rf'''regexp_replace({x}, '\s+', ' ', 'g')''')}, 1, 500)"

BLOCK_ROWS = rf"""lines AS (
  SELECT doc_id, pos, {strip("line")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), kinds AS (
  SELECT *, CASE WHEN line = '' OR starts_with(line, '[Page ') THEN 'gap' WHEN ends_with(lower(line), ', continued') OR {METADATA} THEN 'skip' WHEN {HEADING} THEN 'heading' ELSE 'text' END AS kind FROM lines
), islands AS (
  SELECT *, last_value(CASE WHEN kind = 'heading' THEN {strip("regexp_replace(line, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section,
    sum((kind IN ('gap', 'heading'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM kinds
), blocks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_index, section, string_agg(line, ' ' ORDER BY pos) AS block
  FROM islands WHERE kind = 'text' GROUP BY doc_id, island, section
)"""
BLOCKS = f"WITH {BLOCK_ROWS} SELECT doc_id, block_index, coalesce(section, '') AS section, md5(block) AS digest FROM blocks"

_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(block, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def _ended(text: str, section: str, done: str, prefix: str) -> str:
    """What an ended passage leaves: the passages so far and the words that lead the next one."""
    body, own = text, f"coalesce({section}, '')"
    front = rf"""({words(body)} < 50 AND (NOT regexp_matches({body}, '[a-z]{{2,}}[^.!?]*[.!?]')
      OR ({section} IS NULL AND regexp_matches(lower({body}), 'approved by the board|effective august|posted for campus notice|policy library'))))"""
    full = f"(CASE WHEN {own} = '' OR starts_with({body}, {own}) THEN {body} ELSE {own} || chr(10) || chr(10) || {body} END)"
    tail = rf"array_to_string(regexp_extract_all({full}, '\S+')[-50:], ' ')"
    return (
        f"CASE WHEN {front} THEN {done} ELSE list_append({done}, struct_pack(section := {section}, text := {full})) END AS {prefix}done, "
        f"CASE WHEN {front} THEN NULL ELSE {tail} END AS {prefix}lead"
    )


def _body(first: str, end: str, lead: str) -> str:
    """Pieces first to end - 1, counted from 0, after the words that lead them."""
    blocks = f"array_to_string(list_transform(p[{first} + 1 : {end}], lambda x: x.block), chr(10) || chr(10))"
    return f"concat_ws(chr(10) || chr(10), nullif({lead}, ''), {blocks})"


#: Sentences are dealt to pieces, then pieces to passages, one a step of each recursion.
PASSAGES = rf"""{BLOCK_ROWS}, long_blocks AS (
  SELECT doc_id, block_index, section, {_SENTENCES} AS s FROM blocks WHERE {words('block')} > 380
), dealt(doc_id, block_index, section, s, i, size, k, piece) AS (
  SELECT doc_id, block_index, section, s, 0, 0, -1, NULL::VARCHAR FROM long_blocks
  UNION ALL
  SELECT doc_id, block_index, section, s, i + 1, CASE WHEN i = 0 OR size + n > 380 THEN n ELSE size + n END, CASE WHEN i = 0 OR size + n > 380 THEN k + 1 ELSE k END, s[i + 1]
  FROM (SELECT *, {words('s[i + 1]')} AS n FROM dealt WHERE i < len(s))
), whole AS (
  SELECT doc_id, block_index, section, k, string_agg(piece, ' ' ORDER BY i) AS block, count(*) AS parts FROM dealt WHERE i > 0 GROUP BY ALL
), cut AS (
  SELECT doc_id, block_index, section, k, 0 AS w, block FROM whole WHERE parts > 1 OR {words('block')} <= 380
  UNION ALL SELECT doc_id, block_index, section, k, w, array_to_string(v[w + 1 : w + 380], ' ')
  FROM (SELECT *, unnest(range(0, len(v), 380)) AS w FROM (SELECT *, regexp_extract_all(block, '\S+') AS v FROM whole WHERE parts = 1 AND {words('block')} > 380))
  UNION ALL SELECT doc_id, block_index, section, 0, 0, block FROM blocks WHERE {words('block')} <= 380
), lists AS (
  SELECT doc_id, list(struct_pack(section := section, block := block, n := {words('block')}) ORDER BY block_index, k, w) AS p FROM cut GROUP BY doc_id
), fold(doc_id, p, i, at_, size, lead, done) AS (
  SELECT doc_id, p, 0, -1, 0, NULL::VARCHAR, []::STRUCT(section VARCHAR, text VARCHAR)[] FROM lists
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN size3 >= 320 THEN -1 ELSE at3 END, CASE WHEN size3 >= 320 THEN 0 ELSE size3 END::INT,
    CASE WHEN size3 >= 320 THEN elead ELSE lead3 END, CASE WHEN size3 >= 320 THEN edone ELSE done3 END
  FROM (
    SELECT *, {_ended(_body('at3', '(i + 1)', 'lead3'), 'p[at3 + 1].section', 'done3', 'e')} FROM (
      SELECT *, CASE WHEN at2 < 0 THEN i ELSE at2 END AS at3, CASE WHEN at2 < 0 THEN coalesce({words('lead2')}, 0) + p[i + 1].n ELSE size + p[i + 1].n END AS size3, lead2 AS lead3, done2 AS done3 FROM (
        SELECT *, CASE WHEN other OR over_ THEN -1 ELSE at_ END AS at2, CASE WHEN other THEN NULL WHEN over_ THEN blead ELSE lead END AS lead2, CASE WHEN other OR over_ THEN bdone ELSE done END AS done2 FROM (
          SELECT *, at_ >= 0 AND p[i + 1].section IS DISTINCT FROM p[at_ + 1].section AS other, at_ >= 0 AND size + p[i + 1].n > 380 AS over_,
            {_ended(_body('at_', 'i', 'lead'), 'p[at_ + 1].section', 'done', 'b')}
          FROM fold WHERE i < len(p)
        )
      )
    )
  )
), passages AS (
  SELECT doc_id, unnest(range(len(done))) AS chunk_index, unnest(done) AS x FROM (
    SELECT doc_id, CASE WHEN at_ >= 0 THEN edone ELSE done END AS done FROM (SELECT *, {_ended(_body('at_', 'i', 'lead'), 'p[at_ + 1].section', 'done', 'e')} FROM fold WHERE i = len(p))
  )
)"""

_REPEATED = (
    "(" + " OR ".join([f"starts_with(line, {_q(x)})" for x in REPEATED_STARTS] + [f"line IN ({_list(REPEATED_LINES)})"] + [f"regexp_full_match(line, {_q(x)})" for x in REPEATED_PATTERNS]) + ")"
)
_NOT_JOINED = r"(line = '' OR starts_with(line, '[Page ') OR regexp_matches(line, '^(\d+\.|[a-zA-Z]\.|[ivxlcdmIVXLCDM]+\.)\s+') OR " + TITLE + ")"
_REPAIRED = "joined"
for _cut in CUT_SENTENCES:
    _REPAIRED = f"replace({_REPAIRED}, {_q(_cut)}, '')"
_REPAIRED = rf"regexp_replace(regexp_replace({_REPAIRED}, '\b([A-Za-z]+)-\s+([A-Za-z]+)\b', '\1\2', 'g'), '\b([A-Za-z]+)\s+-\s+([A-Za-z]+)', '\1-\2', 'g')"
for _old, _new in REPAIRS.items():
    _REPAIRED = f"replace({_REPAIRED}, {_q(_old)}, {_q(_new)})"
_SQUEEZED = strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")
_TIGHT = strip(r"regexp_replace(regexp_replace(x, '\b([A-Za-z]+)\s+-\s+([A-Za-z]+)', '\1-\2', 'g'), '\s{2,}', ' ', 'g')")
#: Page text line by line; wrapped lines are put together one a step of the recursion.
PDF = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, list_transform(list_transform(string_split(translate(text, chr(160) || '–—', ' --'), chr(10)), lambda x: {_SQUEEZED}), lambda x: {_TIGHT}) AS l FROM documents
), told AS (SELECT doc_id, list_transform(l, lambda line: CASE WHEN {CONTENTS} THEN '' ELSE line END) AS l FROM raw),
once AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')) AS l FROM told),
kept AS (SELECT doc_id, list_filter(l, lambda line: NOT regexp_matches(line, '^\d+$') AND NOT {_REPEATED}) AS l FROM once),
fold(doc_id, l, i, parts, last) AS (
  SELECT doc_id, l, 0, []::VARCHAR[], '' FROM kept
  UNION ALL
  SELECT doc_id, l, i + 1, CASE WHEN joins THEN list_append(parts[:-2], last || ' ' || line) ELSE list_append(parts, line) END, CASE WHEN joins THEN last || ' ' || line ELSE line END
  FROM (
    SELECT *, l[i + 1] AS line, NOT ({_NOT_JOINED.replace('line', 'l[i + 1]')} OR last = '' OR starts_with(last, '[Page ') OR {TITLE.replace('line', 'last')} OR regexp_matches(last, '[.?!:;)]$')) AS joins
    FROM fold WHERE i < len(l)
  )
), put AS (SELECT doc_id, array_to_string(parts, chr(10)) AS joined FROM fold WHERE i = len(l))
SELECT doc_id, {strip(rf"regexp_replace({_REPAIRED}, '\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM put
"""

_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""
_LINES = f"list_transform(string_split(translate(raw, chr(160) || '–—', ' --'), chr(10)), lambda x: {_SQUEEZED})"
#: Articles of the table's pages: a paragraph that is never closed holds all that follow, which are written alone as well.
PAGE_TEXT = rf"""
WITH inside AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
parts AS (SELECT page_id, string_split(a, '</h1>')[1] AS h, string_split(string_split(a, '</h1>')[2], '<p>')[2:] AS p FROM inside),
texts AS (SELECT page_id, list_transform([h], lambda x: {strip(_PLAIN)})[1] AS h, list_transform(p, lambda x: {strip(_PLAIN)}) AS t, list_transform(p, lambda x: NOT contains(x, '</p>')) AS o FROM parts),
put AS (
  SELECT page_id, chr(10) || h || chr(10) || chr(10) ||
    array_to_string(list_filter(list_transform(t, lambda x, i: CASE WHEN o[i] THEN array_to_string(list_filter(t[i:], lambda y: y <> ''), ' ') ELSE x END), lambda x: x <> ''), chr(10)) AS raw FROM texts
), lined AS (SELECT page_id, {_LINES} AS l FROM put)
SELECT page_id, {strip(r"""regexp_replace(array_to_string(list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')""")} AS text FROM lined
"""

_PROMPT_HEAD = "'Question ID: ' || question_id || chr(10) || 'Question: ' || question"
_BLOCK = "'[chunk_id: ' || c.chunk_id || ']' || chr(10) || 'title: ' || coalesce(title, 'None') || chr(10) || 'section: ' || coalesce(section, 'None') || chr(10) || 'text:' || chr(10) || c.text"
PROMPTS = f"""WITH {CHUNKS}, {ASKED}, {ranked(5)}, made AS (
  SELECT a.question_id, {_PROMPT_HEAD.replace('question_id', 'a.question_id')} || chr(10) || chr(10) || 'Evidence chunks:' || chr(10) || coalesce(e.evidence, '') || chr(10) || chr(10) || 'Answer using only the evidence chunks above.' AS input
  FROM asked a LEFT JOIN (SELECT question_id, string_agg({_BLOCK}, chr(10) ORDER BY rank) AS evidence FROM ranked r JOIN chunks c USING (chunk_id) GROUP BY 1) e USING (question_id)
) SELECT question_id, length(input) AS n_chars, md5(input) AS digest FROM made"""


_REQUIRED = "[" + _list(REQUIRED) + "]"
_LOST = f"list_sort(list_filter({_REQUIRED}, lambda k: (item_id % 5 = 0 AND k IN ('notes', 'qrels')) OR (item_id % 7 = 0 AND k = 'topic')))"
def _cleaned(x: str) -> str:
    """Keywords squeezed, without empty ones and repeats but for case."""
    squeezed = f"list_filter(list_transform({x}, lambda k: {strip(r"regexp_replace(k, '\s+', ' ', 'g')")}), lambda k: k <> '')"
    return f"(SELECT list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) FROM (SELECT {squeezed} AS k))"


def _round(number: int, before: str, previous: str) -> str:
    """One round of the keyword loop around the stub model of the query."""
    name, words_ = f"round{number}", r"list_filter(string_split_regex(question, '\s+'), lambda w: w <> '')"
    return f"""{name}_asked AS (
  SELECT question_id, asked_question, keywords, {strip("concat_ws(' ', asked_question, array_to_string(keywords, ' '))")} AS question
  FROM (SELECT question_id, question AS asked_question, {_cleaned(f"list_concat({previous}, {words_}[1 : len({previous}) + 2])")} AS keywords FROM {before})
), {ranked(5, name, asked=f"{name}_asked")}, {name}_found AS (
  SELECT a.*, coalesce(f.ids, []) AS ids, len(coalesce(f.ids, [])) > 0 AND length(asked_question) % 3 = 0 AS is_supported
  FROM {name}_asked a LEFT JOIN (SELECT question_id, list(chunk_id ORDER BY rank) AS ids FROM {name} GROUP BY 1) f USING (question_id)
), {name}_open AS (SELECT question_id, asked_question AS question, keywords FROM {name}_found WHERE NOT is_supported)"""


def _trace(number: int) -> str:
    return (
        f"SELECT question_id, {number} AS iteration, array_to_string(keywords, '|') AS keywords, md5(question) AS query_md5, array_to_string(ids, ',') AS retrieved, array_to_string(ids[1:1], ' ') AS answer, "
        f"len(ids) = 0 AS abstained, array_to_string(ids[1:2], ',') AS citations, is_supported FROM round{number}_found"
    )


FULL_REVIEWS = f"""{REVIEWS}, full_revs AS (
  SELECT question_id // 6 AS question_id, question_id AS i, system, answerable, abstained, manual_correct, manual_citation_supported, manual_hallucinated, review_abstention_correct, severity,
    'q' || question_id AS question, CASE WHEN question_id % 3 <> 0 THEN 'g' || question_id END AS gold_answer_short, 'a' || question_id AS model_answer, CASE WHEN abstained THEN 'short' END AS reason
  FROM revs
)"""


def _more_sql() -> dict[str, str]:
    copied = ", counted AS (SELECT r.*, c.question_id AS id, c.row, c.question AS shown FROM records r JOIN copies c ON c.of = r.question_id)"
    review = ["question", "answerable::VARCHAR", "gold_answer_short", chunk_id("i"), "model_answer", "abstained::VARCHAR", "reason", chunk_id("i + 1"), f"{chunk_id('i')} || ',' || {chunk_id('i + 1')}"]
    review += [f"{c}::VARCHAR" for c in ("manual_correct", "manual_citation_supported", "manual_hallucinated", "review_abstention_correct")] + ["severity", "''"]
    searches = ", ".join(f"({_q(s)}, {_q(r) if r else 'NULL'})" for s, r in SYSTEM_RETRIEVERS.items())
    shown = "array_to_string([rank::VARCHAR, chunk_id, doc_id::VARCHAR, relevance::VARCHAR, is_gold_doc::VARCHAR, is_near_miss_doc::VARCHAR], ' ')"
    own = "(is_supported OR abstained)"
    return {
        "predictions": EVALUATED + f" SELECT q.question_id, answerable, topic, question_type, difficulty, r.retrieved FROM questions q LEFT JOIN (SELECT question_id, string_agg({shown}, ', ' ORDER BY rank) AS retrieved FROM judged GROUP BY 1) r USING (question_id)",
        "iterkey_trace": f"WITH {CHUNKS}, {ASKED}, {_round(1, 'asked', '[]::VARCHAR[]')}, {_round(2, 'round1_open', 'keywords')}, trace AS ({_trace(1)} UNION ALL {_trace(2)}), "
        f"last AS (SELECT question_id, CASE WHEN {own} THEN answer ELSE '' END AS final_answer, CASE WHEN {own} THEN '' ELSE 'No support was confirmed after ' || iteration || ' iterations.' END AS reason, "
        f"CASE WHEN {own} THEN citations ELSE retrieved END AS final_citations FROM trace QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY iteration DESC) = 1) SELECT * FROM trace JOIN last USING (question_id)",
        "pdf_clean": PDF,
        "html_text": PAGE_TEXT,
        "date_stamps": "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'reviewed-results-snapshot' ELSE strftime(TIMESTAMP '2026-01-31 21:05:09' + to_hours(item_id * 7), '%-m/%-d/%Y, %-I:%M:%S %p') END AS shown FROM benchmark",
        "jsonl_round_trip": "SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents",
        "missing_fields": f"SELECT 'q' || item_id AS question_id, 'error' AS severity, 'missing_fields' AS rule, 'missing required fields: ' || array_to_string({_LOST}, ', ') AS message FROM benchmark WHERE len({_LOST}) > 0",
        "not_boolean": "SELECT 'q' || item_id AS question_id, 'error' AS severity, 'not_boolean' AS rule, 'answerable must be a boolean' AS message FROM benchmark WHERE item_id % 3 = 0 OR item_id % 4 = 0",
        "gates": "SELECT * FROM (VALUES ('benchmark with errors', true), ('benchmark with warnings', false), ('missing labels', true), ('no reviews', true)) t(input, refused)",
        "open_prompts": f"WITH {ASKED} SELECT question_id, md5({_PROMPT_HEAD}) AS digest FROM asked",
        "retriever_descriptions": f"WITH {CHUNKS} SELECT 'bm25' AS name, n, 1.2::DOUBLE AS k1, 0.65::DOUBLE AS b, round(average_length, 6) AS average, expanded FROM stats CROSS JOIN (VALUES (false), (true)) t(expanded)",
        "system_searches": f"SELECT * FROM (VALUES {searches}) t(system, search)",
        "embedding_cache": "SELECT vec_id AS position, vec_id::VARCHAR AS chunk_id, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total, true AS others_refused FROM embeddings",
        "dashboard_questions": f"{RECORDS}{copied} SELECT id AS question_id, md5(shown) AS question, answerable, topic, difficulty, question_type, md5(gold_answer) AS gold_answer_short, array_to_string(list_sort(gold_chunks), ',') AS gold_chunk_ids, array_to_string(list_sort(gold_docs::VARCHAR[]), ',') AS gold_doc_ids, rationale AS negative_rationale FROM counted",
        "dashboard_reviews": f"WITH {FULL_REVIEWS} SELECT question_id, system, md5(concat_ws('|', {', '.join(review)})) AS digest FROM full_revs",
        "dashboard_bundle": f"WITH {FULL_REVIEWS} SELECT question_id, string_agg(system || '=' || model_answer, ',' ORDER BY system || '=' || model_answer) AS answers FROM full_revs GROUP BY 1",
        "question_detail": f"{RECORDS}, {FULL_REVIEWS}, one AS (SELECT * FROM records WHERE question_id > 0 ORDER BY difficulty <> 'hard', question_id LIMIT 1) SELECT o.question_id, md5(o.question) AS question_md5, o.answerable, md5(CASE WHEN o.answerable THEN gold_answer ELSE rationale END) AS gold_md5, r.system, list_position({SYSTEM}, r.system)::INT AS position, r.manual_correct FROM one o LEFT JOIN full_revs r USING (question_id)",
    }


def oracle_sql() -> dict[str, str]:
    scored_columns = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for k in KS for m in ("recall", "doc_recall", "ndcg", "near_miss_doc"))
    probe = "CASE WHEN item_id % 3 = 0 THEN text || ' Leave of Absence — discipline' ELSE text END"
    cut = "list_filter(list_transform(list_concat(string_split(text, ' '), ['  The ' || chr(9), '']), lambda k: " + strip(r"regexp_replace(k, '\s+', ' ', 'g')") + "), lambda k: k <> '')"
    final = "SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM "
    labels = [
        ("missing", "manual_correct IS NULL", "'manual_correct'"), ("missing", "manual_hallucinated IS NULL", "'manual_hallucinated'"), ("missing", "severity IS NULL", "'review_hallucination_severity'"),
        ("missing", "NOT answerable AND review_abstention_correct IS NULL", "'review_abstention_correct'"), ("missing", "system <> 'non_rag' AND manual_citation_supported IS NULL", "'manual_citation_supported'"),
        ("invalid", "manual_hallucinated AND severity = 'none'", "'hallucinated without severity'"), ("invalid", "NOT manual_hallucinated AND severity IN ('minor', 'major')", "'not hallucinated but ' || severity"),
    ]
    percent = lambda x: f"printf('%.1f%%', round({x} * 100, 1))"
    text = r"chr(160) || ' – a' || chr(9) || ' b' || repeat(chr(10), 3) || text"
    tidy = rf"list_transform(string_split(translate({text}, chr(160) || '–—', ' --'), chr(10)), lambda l: {strip(rf'''regexp_replace(l, '[ \t]+', ' ', 'g')''')})"
    return _more_sql() | {
        "tokenize_counts": f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, array_to_string(list_slice(t, 1, 5), ' ') AS head FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
        "tokenize_no_stop": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens('text', False)} AS t FROM documents)",
        "expand_queries": f"SELECT item_id, {expanded('p')} AS expanded FROM (SELECT item_id, {probe} AS p FROM benchmark)",
        "word_stats": rf"SELECT doc_id, len(w) AS n_words, array_to_string(list_slice(w, greatest(len(w) - 4, 1), len(w)), ' ') AS tail, {PREVIEW('text')} AS preview FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents)",
        "normalize_question": r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded FROM benchmark",
        "keyword_cleanup": f"SELECT item_id, array_to_string(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i), '|') AS keywords FROM (SELECT item_id, {cut} AS k FROM benchmark)",
        "clean_lines": rf"SELECT doc_id, md5({strip(r'''regexp_replace(array_to_string(list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')''')}) AS digest FROM (SELECT doc_id, {tidy} AS l FROM documents)",
        "line_flags": f"SELECT doc_id, count(*) AS n, count_if({CONTENTS})::BIGINT AS contents, count_if({TITLE})::BIGINT AS titles, count_if({HEADING})::BIGINT AS headings, count_if({LETTERED})::BIGINT AS lettered, count_if({METADATA})::BIGINT AS metadata FROM (SELECT doc_id, {strip('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY doc_id",
        "page_hashes": "SELECT page_id, sha256(html) AS sha256 FROM pages",
        "section_blocks": BLOCKS,
        "chunk_passages": f"WITH RECURSIVE {PASSAGES} SELECT doc_id, printf('%d__%04d', doc_id, chunk_index) AS chunk_id, chunk_index::INT AS chunk_index, x.section AS section, x.text AS text, {words('x.text')}::INT AS word_count FROM passages",
        "sentence_split": rf"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents)",
        "term_freq": f"WITH {CHUNKS} SELECT chunk_id, count(*) AS n_terms, sum(tf)::BIGINT AS length, max(tf) AS most, count_if(named)::BIGINT AS named FROM postings GROUP BY 1",
        "doc_freq_idf": f"WITH {CHUNKS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM frequent CROSS JOIN stats",
        "corpus_stats": f"WITH {CHUNKS} SELECT n, round(average_length, 6) AS average_length FROM stats",
        "bm25_topk": f"WITH {CHUNKS}, {ASKED}, {ranked(10)} {final} ranked",
        "bm25_passages": f"WITH RECURSIVE {PASSAGES}, {PASSAGE_CHUNKS}, {ENTRIES}, {ASKED}, {ranked(10)} {final} ranked",
        "bm25_expanded": f"WITH {CHUNKS}, {ASKED}, {ranked(5, expand=True)} {final} ranked",
        "dense_topk": "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id))::INT AS rank FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5)",
        "rerank_topk": f"WITH {CHUNKS}, {ASKED}, {ranked(20)}, {reranked('ranked', 5)} {final} again",
        "qrel_flags": EVALUATED + " SELECT question_id, rank, chunk_id, relevance, is_gold_doc, is_near_miss_doc FROM judged",
        "question_metrics": EVALUATED + f" SELECT question_id, answerable, round(rr, 6) AS rr, {scored_columns} FROM scored",
        "metrics_by_slice": SLICES,
        "unanswerable_metrics": UNANSWERABLE,
        "compare_overall": f"{COMPARED}, {CASES}, every AS (SELECT * FROM (VALUES (1), (3), (5), (10)) a(k), (VALUES ('both_hit'), ('left_only'), ('right_only'), ('both_miss')) b(bucket)) SELECT e.k, e.bucket, count(question_id) AS n, coalesce(string_agg(question_id::VARCHAR, ',' ORDER BY question_id), '') AS ids FROM every e LEFT JOIN (SELECT *, {BUCKET} AS bucket FROM cases) c ON c.k = e.k AND c.bucket = e.bucket GROUP BY 1, 2",
        "compare_by_slice": f"{COMPARED}, {CASES}, named AS (SELECT *, {BUCKET} AS bucket FROM cases), long AS (SELECT 'topic' AS slice, topic AS \"group\", k, bucket FROM named UNION ALL SELECT 'question_type', question_type, k, bucket FROM named UNION ALL SELECT 'difficulty', difficulty, k, bucket FROM named) SELECT slice, \"group\", k, count_if(bucket = 'both_hit')::BIGINT AS both_hit, count_if(bucket = 'left_only')::BIGINT AS left_only, count_if(bucket = 'right_only')::BIGINT AS right_only, count_if(bucket = 'both_miss')::BIGINT AS both_miss FROM long GROUP BY 1, 2, 3",
        "compare_detail": f"{COMPARED} SELECT b.question_id, first_rank AS left_rank, r_first_rank AS right_rank, l.chunk_id AS left_top, r.chunk_id AS right_top FROM both_sides b LEFT JOIN ranked l ON l.question_id = b.question_id AND l.rank = 1 LEFT JOIN again r ON r.question_id = b.question_id AND r.rank = 1",
        "validate_findings": FINDINGS,
        "validate_summary": RECORDS + ", counted AS (SELECT r.* FROM records r JOIN copies c ON c.of = r.question_id) " + " UNION ALL ".join([f"SELECT '{scope}' AS scope, {value} AS value, count(*) AS n FROM counted GROUP BY ALL" for scope, value in (("answerability", "CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END"), ("topic", "topic"), ("question_type", "question_type"), ("difficulty", "difficulty"))] + ["SELECT 'gold_doc', d::VARCHAR, count(*) FROM (SELECT unnest(gold_docs) AS d FROM counted) GROUP BY ALL"]),
        "near_duplicate_pairs": f"{RECORDS} {PAIRS}",
        "near_duplicate_groups": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS group_id, count(*) OVER (PARTITION BY key) AS group_size FROM (SELECT doc_id, {FOLDED} AS key FROM documents)",
        "gen_prompts": PROMPTS,
        "gen_dry_run": f"WITH {CHUNKS}, {ASKED}, {ranked(5)} SELECT a.question_id, a.question, true AS abstained, 'bm25_rag' AS system, count(r.chunk_id) AS n_retrieved, any_value(r.chunk_id) FILTER (r.rank = 1) AS top, md5(any_value({PREVIEW('c.text')}) FILTER (r.rank = 1)) AS preview_md5 FROM asked a LEFT JOIN ranked r USING (question_id) LEFT JOIN chunks c ON c.chunk_id = r.chunk_id GROUP BY a.question_id, a.question",
        "citation_flags": f"WITH {GENERATIONS} SELECT question_id, system, answerable, abstained, answered, citation_count, len(missing) = 0 AS citations_exist, len(outside) = 0 AS citations_in_retrieved, has_gold_citation, array_to_string(missing, ',') AS missing_citations, array_to_string(outside, ',') AS not_retrieved_citations, answer_nonempty FROM flags",
        "heuristic_metrics": f"WITH {GENERATIONS} SELECT system, count(*) AS num_generations, {rate('answered')} AS answer_rate, {rate('abstained')} AS abstention_rate, count_if(answerable)::BIGINT AS num_answerable, {rate('abstained', 'answerable')} AS over_abstention_rate, {rate('answered', 'answerable')} AS answered_rate, {rate('has_gold_citation', 'answerable')} AS gold_citation_hit_rate, count_if(NOT answerable)::BIGINT AS num_unanswerable, {rate('abstained', 'NOT answerable')} AS correct_abstention_rate, {rate('answered', 'NOT answerable')} AS false_answer_rate, {rate('len(missing) = 0')} AS citation_validity_rate, {rate('len(outside) = 0')} AS citation_in_retrieved_rate, round(avg(citation_count), 6) AS avg_citation_count FROM flags GROUP BY system",
        "review_template": f"WITH {GENERATIONS} SELECT question_id, system, answerable, md5(answer) AS answer_md5, array_to_string(gold, ',') AS gold, NULL::BOOLEAN AS manual_correct, NULL::VARCHAR AS review_hallucination_severity, '' AS manual_notes FROM flags",
        "reviewed_metrics": f"WITH {REVIEWS}, {REVIEWED} SELECT * FROM reviewed",
        "flagged_rows": f"WITH {REVIEWS} SELECT question_id, system, manual_correct, manual_citation_supported, manual_hallucinated FROM revs WHERE {ISSUE}",
        "label_findings": f"WITH {REVIEWS} " + " UNION ALL ".join(f"SELECT question_id, system, '{k}' AS kind, {m} AS message FROM revs WHERE {w}" for k, w, m in labels),
        "issue_counts": f"WITH {REVIEWS} SELECT question_id, count(*) FILTER (manual_correct) AS correct, count(*) FILTER (manual_hallucinated) AS hallucinated, count(*) FILTER (NOT manual_citation_supported) AS unsupported_citation FROM revs GROUP BY 1",
        "explorer_filter": f"WITH {QRELS}, {REVIEWS}, issues AS (SELECT DISTINCT question_id FROM revs WHERE {ISSUE}) " + " UNION ALL ".join(
            f"SELECT {_q(name)} AS filter, question_id, md5(question) AS question_md5 FROM questions WHERE {where}"
            for name, where in (
                ("text", "contains(lower(question), 'the')"), ("id", "contains(lower(question), '1') OR contains(question_id::VARCHAR, '1')"), ("medium", "difficulty = 'medium'"),
                ("none", "topic = 'none'"), ("answerable", "answerable"), ("issues", "question_id IN (SELECT question_id FROM issues)"),
                ("all", "(contains(lower(question), 'an') OR contains(question_id::VARCHAR, 'an')) AND difficulty = 'medium' AND question_id IN (SELECT question_id FROM issues)"),
            )
        ),
        "facets": f"WITH {QRELS} SELECT DISTINCT 'topic' AS facet, topic AS value FROM questions UNION SELECT DISTINCT 'difficulty', difficulty FROM questions",
        "system_summary": f"WITH {REVIEWS}, {REVIEWED} SELECT list_position({SYSTEM}, system)::INT AS position, array_to_string(list_transform(string_split(system, '_'), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS name, {percent('reviewed_correct_rate')} AS correct, {percent('reviewed_hallucination_rate')} AS hallucinated, CASE WHEN system = 'non_rag' THEN 'n/a' ELSE {percent('citation_support_rate')} END AS citation_support FROM reviewed",
        "shown_answers": f"WITH {GENERATIONS} SELECT question_id, md5(coalesce(CASE WHEN NOT abstained THEN nullif(answer, '') END, CASE WHEN system <> 'non_rag' THEN 'abstained' END, 'No answer recorded.')) AS shown_md5 FROM flags",
    }
