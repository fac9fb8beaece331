"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import chat_format, embedding_dedup, exact_dedup, filter_audit, licenses, line_dedup, mixing, packing, quality, sharding, simhash, spelling, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    done = line_dedup.line_dedup(_table(spark, d, "documents").select("doc_id", "text"))
    lengths = F.transform("removed_runs", lambda r: r["last"] - r["first"] + 1)
    removed = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select(
        "doc_id", "n_lines", removed.alias("removed_lines"), F.size("removed_runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest_run"), F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(_table(spark, d, "documents")).drop("spans")


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_table(spark, d, "documents"))


def op4_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.sharding(_table(spark, d, "documents"))


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_of(chat_format.format_conversations(rows.unionByName(extra)))


def op5_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, d, "embeddings"))


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classified(_table(spark, d, "documents"), _table(spark, d, "labels")).drop("key")


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, d, "documents"))


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, d, "documents"))


def op11_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, d, "documents")))


def op12_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, d, "documents"))


def op13_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, d, "documents"), _table(spark, d, "labels"))


EXACT_DEDUP_SQL = r"""
WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


# later copies of three lines, and of one or two lines that have over 50 words
LINE_DEDUP_SQL = r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS raw, trim(unnest(ls), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM a),
w AS (SELECT doc_id, line, t AS g1, [t, lead(t, 1) OVER d] AS g2, [t, lead(t, 1) OVER d, lead(t, 2) OVER d] AS g3, lead(line, 1) OVER d AS full2, lead(line, 2) OVER d AS full3,
  len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w1, lead(len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')), 1) OVER d AS w2 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
k AS (SELECT doc_id, line, full2, full3, w1, w2, row_number() OVER (PARTITION BY g1 ORDER BY doc_id, line) AS k1 FROM w),
k2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY g2 ORDER BY doc_id, line) AS k2 FROM w WHERE full2 IS NOT NULL),
k3 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY g3 ORDER BY doc_id, line) AS k3 FROM w WHERE full3 IS NOT NULL),
gone AS (SELECT doc_id, line + unnest([0, 1, 2]) AS line FROM k3 WHERE k3 > 1
  UNION SELECT k.doc_id, k.line + unnest([0, 1]) FROM k JOIN k2 ON k.doc_id = k2.doc_id AND k.line = k2.line WHERE k2 > 1 AND w1 + w2 > 50
  UNION SELECT doc_id, line FROM k WHERE k1 > 1 AND w1 > 50),
m AS (SELECT l.doc_id, l.line, raw, gone.line IS NOT NULL AS out FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM m WHERE out) GROUP BY doc_id, island),
s AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM r GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS removed_lines,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT out), '')) AS clean_sha256 FROM m GROUP BY doc_id)
SELECT t.doc_id, n_lines, removed_lines, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, clean_sha256
FROM t LEFT JOIN s ON t.doc_id = s.doc_id
"""

# links and components by brute force, within a label
EMBEDDING_DEDUP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""

# tokens decide formatted_chars no more than texts do: every control string is fixed text
CHAT_FORMAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + 2 + 9 + length(regexp_replace(role, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')) + length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

# checksums by a table of 256 remainders; near words by what is left of a word without one code point
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS g(i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
b AS (SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 + (unicode(s) >> 6) AS BIGINT), CAST(128 + (unicode(s) & 63) AS BIGINT)] END)) AS bytes FROM k),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
s AS (SELECT DISTINCT d.word AS a, d.n AS an, w.word AS b, w.n AS bn FROM d JOIN w ON d.rest = w.word),
p AS (SELECT x.word AS a, y.word AS b, y.n FROM d x JOIN d y ON x.l = y.l AND x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, b, bn FROM s UNION ALL SELECT b, a, an FROM s),
q AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 2 * w.n THEN q.b END AS form, CASE WHEN q.n >= 2 * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON w.word = q.a AND q.place = 1),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word JOIN f e ON e.word = c.root WHERE e.form IS NULL
"""

# documents counted by part, labels and failed filters, then every order by what each class of them meets
FILTER_AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, len(list_filter(fails, lambda x: x)) AS k, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, step, seq[step] AS own, seq[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, k, fails[own] AS fail, coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) AS gone FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fail AND NOT gone) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant,
  sum(n) FILTER (fail AND k = 1) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup, "op2_licenses": op2_licenses, "op3_packing": op3_packing, "op4_sharding": op4_sharding, "op5_embedding_dedup": op5_embedding_dedup,
        "op6_quality": op6_quality, "op7_simhash": op7_simhash, "op8_mixing": op8_mixing, "op9_chat_format": op9_chat_format, "op10_exact_dedup": op10_exact_dedup,
        "op11_spelling": op11_spelling, "op12_token_counts": op12_token_counts, "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op5_embedding_dedup": EMBEDDING_DEDUP_SQL, "op9_chat_format": CHAT_FORMAT_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL, "op11_spelling": SPELLING_SQL, "op13_filter_audit": FILTER_AUDIT_SQL}
