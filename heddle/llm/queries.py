"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import repair_damaged
from .decontaminate import decontaminate
from .divergence import audit_sources
from .lm import score_texts
from .ngram_join import near_duplicates
from .packing import pack
from .pii import detect_pii
from .quality import score_quality, train_quality
from .secret_scan import detect_secrets
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import score_toxicity, train_toxicity
from .url_filter import judge_urls

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, train_quality(documents, table(spark, sf_dir, "labels")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, train_toxicity(documents, table(spark, sf_dir, "labels")))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_secrets(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_url_cascade": op7_url_cascade,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_context_mixing": op10_context_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

LOWER_SQL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM p
), r(action, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, host, path, max({'n': length(rh || rp), 'rule': rh || rp, 'action': action}) AS best
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY ALL
)
SELECT page_id, host, path, CASE WHEN best.n IS NULL THEN NULL ELSE best.rule END AS rule, coalesce(best.action, 'allow') AS verdict FROM m
"""

_WORDS = r"regexp_extract_all(" + LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, w[s : s + least(10, len(w)) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, s, w[s : s + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
),
m AS (SELECT DISTINCT doc_id, item, s, win.n AS n FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(""" + LOWER_SQL.format("text") + r""", '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) AS c USING (doc_id)
"""

OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all({LOWER_SQL.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, k.total FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY lang, source),
p AS (
  SELECT x.lang, x.source, x.term, x.c, 1 + CAST(1000000000 AS HUGEINT) * (x.c + 2) // (n.n + 2 * l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (x.total + 2) // (l.all_n + 2 * l.v) AS q
  FROM x JOIN n ON n.lang = x.lang AND n.source = x.source JOIN l ON l.lang = x.lang
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q
), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 10
"""

# Best ways to the end from each last speaker (none, system, user, assistant), row by row from the last; a struct orders by cost, then audit.
_BEST = "{{'cost': {cost}, 'audit': {audit}, 'lines': {lines}}}"
_ON = "{{'cost': {c} + {to}.cost, 'audit': '{e}' || {to}.audit, 'lines': {lines} || {to}.lines}}"
_SAID = "CASE WHEN fault IN (1, 2) THEN NULL ELSE {} END"


def _pass_sql(last: str, free: str, role: str, kept: list[tuple[str, str]]) -> str:
    """The best way past a row: delete, give the free role, or keep where its speaker may speak."""
    ways = [_ON.format(c=4, to=last, e="D", lines="CAST([] AS VARCHAR[])")]
    ways.append(_SAID.format(_ON.format(c="3 + 3 * (fault = 3)::INT", to=free, e="R", lines=f"['{role}:' || text]")))
    ways += [f"CASE WHEN speaker = '{speaker}' AND fault NOT IN (1, 2) THEN {_ON.format(c='3 * (fault = 3)::INT', to=to, e='K', lines="[role || ':' || text]")} END" for speaker, to in kept]
    return f"list_min([{', '.join(ways)}])"


def _insert_sql(own: str, free: str, role: str) -> str:
    return f"list_min([{own}, {_ON.format(c=3, to=free, e='I', lines=f"['{role}:']")}])"


# CRC-32 bit by bit: the key's bytes, then eight shifts for each.
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_SHIFTS = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))"
CRC_SQL = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({_KEY}) + 1), lambda j: CAST(ascii(substr({_KEY}, j, 1)) AS BIGINT))), lambda c, b: {_SHIFTS}))"

OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0 FROM conversations
), k AS (
  SELECT *, {CRC_SQL} % 20 AS kind FROM c
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text0, '.!?', '') ELSE text0 END AS text,
         sha256(length(role0) || ':' || role0 || text0) AS tie, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM e
), m AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS speaker,
         CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o
), s AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before || speaker NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id
), w AS (
  SELECT conv_id, n AS i, {_BEST.format(cost=0, audit="''", lines="CAST([] AS VARCHAR[])")} AS q0, {_BEST.format(cost=6, audit="'II'", lines="['user:', 'assistant:']")} AS q1,
         {_BEST.format(cost=3, audit="'I'", lines="['assistant:']")} AS q2, {_BEST.format(cost=0, audit="''", lines="CAST([] AS VARCHAR[])")} AS q3 FROM s
  UNION ALL
  SELECT conv_id, i, {_insert_sql("p0", "x2", "user")}, {_insert_sql("p1", "x2", "user")}, x2, {_insert_sql("p3", "p2", "user")}
  FROM (SELECT *, {_insert_sql("p2", "p3", "assistant")} AS x2 FROM (
    SELECT w.conv_id, w.i - 1 AS i, {_pass_sql("q0", "q2", "user", [("s", "q1"), ("u", "q2")])} AS p0, {_pass_sql("q1", "q2", "user", [("u", "q2")])} AS p1,
           {_pass_sql("q2", "q3", "assistant", [("a", "q3")])} AS p2, {_pass_sql("q3", "q2", "user", [("u", "q2")])} AS p3
    FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i))
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(q0.cost, 0) AS BIGINT) AS cost, coalesce(q0.audit, '') AS audit, sha256(coalesce(array_to_string(q0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM c) AS a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = 0
"""

ORACLE: dict[str, str] = {"op1_top_k": OP1_SQL, "op3_ngram_join": OP3_SQL, "op7_url_cascade": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_repair": OP13_SQL}
