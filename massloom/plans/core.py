"""Queries over the driver's tables: every operator family on role-mapped columns, with DuckDB equivalents.

Roles: order is peptide, part is protein, supplier is gene set, user is object, event type is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists, stats, strings
from ..functions.nulls import extract_or_null, zero_to_null
from ..operators import calib, graph, ids, network, noise, proteins, ptm, reshape, sets
from ..operators.batches import tasks
from ..operators.matrices import clamp_range, heatmap_cells
from ..sources.columns import add_run_metadata
from ..sources.texts import attribute_map
from .registry import query, table

# --- delimited lists


@query("delim_expand_tokens", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part")
def delim_expand_tokens(s: SparkSession, d: str) -> DataFrame:
    return lists.expand_delim_column(table(s, d, "part"), "p_name", "p_partkey", "tok", " ")


@query("rejoin_unique_tokens", "SELECT p_brand, string_agg(DISTINCT tok, ';' ORDER BY tok) AS toks FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tok FROM part) GROUP BY p_brand")
def rejoin_unique_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_brand").agg(lists.rejoin_unique_tokens(F.col("p_name"), " ", ";").alias("toks"))


@query("union_tokens", "SELECT p_type, string_agg(DISTINCT tok, ' ' ORDER BY tok) AS toks, count(DISTINCT tok) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS tok FROM part) GROUP BY p_type")
def union_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_type").agg(lists.union_tokens(F.col("p_name"), " ").alias("toks"), F.size(lists.unique_tokens(F.col("p_name"), " ")).cast("long").alias("n"))


@query("regex_nmatches", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]+ing\b')) AS BIGINT) AS n FROM documents")
def regex_nmatches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", lists.n_matches(F.col("text"), r"[a-z]+ing\b").cast("long").alias("n"))


# --- surrogate ids


@query("index_sorted", "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type NULLS LAST) AS type_id FROM part")
def index_sorted(s: SparkSession, d: str) -> DataFrame:
    return ids.index_unique(table(s, d, "part").select("p_partkey", "p_type"), "p_type", "type_id")


@query("index_first_seen", "SELECT event_id, e.event_type, ix FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS ix FROM events GROUP BY event_type) t ON e.event_type = t.event_type")
def index_first_seen(s: SparkSession, d: str) -> DataFrame:
    return ids.index_unique(table(s, d, "events").select("event_id", "event_type"), "event_type", "ix", 0, "event_id")


@query("pepmodstate_ids", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_partkey, l_shipmode) - 1 AS pepmod_id, dense_rank() OVER (ORDER BY l_partkey, l_shipmode, l_quantity) - 1 AS pepmodstate_id FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)")
def pepmodstate_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("peptide_id"), F.concat("l_returnflag", "l_linestatus").alias("pepmod_seq"), F.col("l_quantity").alias("charge"))
    return ids.update_pepmodstates(rows).select("l_orderkey", "l_linenumber", "pepmod_id", "pepmodstate_id")


@query("level_codes", "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS BIGINT) AS code FROM orders")
def level_codes(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    levels = reshape.level_table(orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return reshape.encode(orders, "o_orderpriority", levels, "code").select("o_orderkey", "code")


# --- reshaping

WIDE = ["l_orderkey", "l_linenumber"]


@query("unstack_multi", """SELECT l_returnflag,
  round(sum(CASE WHEN l_linestatus = 'F' THEN q END), 6) AS q_F, round(sum(CASE WHEN l_linestatus = 'F' THEN p END), 6) AS p_F,
  round(sum(CASE WHEN l_linestatus = 'O' THEN q END), 6) AS q_O, round(sum(CASE WHEN l_linestatus = 'O' THEN p END), 6) AS p_O
  FROM (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1, 2) GROUP BY l_returnflag""")
def unstack_multi(s: SparkSession, d: str) -> DataFrame:
    long = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 6).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"))
    return reshape.unstack(long, "l_returnflag", "l_linestatus", ["q", "p"], ["F", "O"])


@query("pivot_longer_multi", """SELECT l_orderkey, l_linenumber, 'a' AS var, l_quantity AS x, l_discount AS y FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'b', l_extendedprice, l_tax FROM lineitem""")
def pivot_longer_multi(s: SparkSession, d: str) -> DataFrame:
    wide = table(s, d, "lineitem").select(*WIDE, F.col("l_quantity").alias("x.a"), F.col("l_discount").alias("y.a"), F.col("l_extendedprice").alias("x.b"), F.col("l_tax").alias("y.b"))
    return reshape.pivot_longer(wide, WIDE)


@query("tensor_dense_fill", """SELECT u.user_id, t.event_type, coalesce(n, 0) AS data FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
  LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.event_type = t.event_type""")
def tensor_dense_fill(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return reshape.frame_to_array(cells, [["user_id"], ["event_type"]], "n", default=0)


@query("tensor_to_frame", "SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS signal FROM embeddings")
def tensor_to_frame(s: SparkSession, d: str) -> DataFrame:
    return reshape.array_to_frame(table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", ["dim"])


@query("nested_unnest", "SELECT p_brand AS \"outer\", p_type AS \"inner\", count(*) AS value FROM part GROUP BY p_brand, p_type")
def nested_unnest(s: SparkSession, d: str) -> DataFrame:
    inner = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    nested = inner.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m")).select(F.create_map("p_brand", "m").alias("m"))
    return reshape.unnest(nested, "m")


@query("subheatmap_cells", """SELECT p_brand, p_type, p_size, n AS value, dense_rank() OVER (ORDER BY p_brand) AS row_index, dense_rank() OVER (ORDER BY p_type) AS col_index,
  dense_rank() OVER (ORDER BY p_size) AS sub_index FROM (SELECT p_brand, p_type, p_size, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1, 2, 3)""")
def subheatmap_cells(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").cast("double").alias("value"))
    return reshape.subheatmap_frame(cells, ["p_brand"], ["p_type"], ["p_size"])


@query("heatmap_matrix", """SELECT r.l_returnflag, c.l_suppkey, coalesce(n, 0) AS "count", CASE WHEN n > 0 THEN round(q, 4) END AS score FROM (SELECT DISTINCT l_returnflag FROM lineitem) r CROSS JOIN (SELECT DISTINCT l_suppkey FROM lineitem) c
  LEFT JOIN (SELECT l_returnflag, l_suppkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01' GROUP BY 1, 2) m ON m.l_returnflag = r.l_returnflag AND m.l_suppkey = c.l_suppkey""")
def heatmap_matrix(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp")
    covers = lines.groupBy("l_returnflag", "l_suppkey").agg(F.avg(F.when(early, F.col("l_quantity"))).alias("set_original_weight"), F.count_if(early).alias("nmasked"))
    cells = heatmap_cells(covers, ["l_returnflag"], ["l_suppkey"])
    return cells.select("l_returnflag", "l_suppkey", "count", F.round(F.nanvl("score", F.lit(None).cast("double")), 4).alias("score"))


# --- sets


@query("sets_min_size", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_objs, min(l_partkey) AS first_obj FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5 AND count(DISTINCT l_partkey) >= 5")
def sets_min_size(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    return sets.set_members(rows, "l_suppkey", "l_partkey", 5).groupBy("l_suppkey").agg(F.count("*").alias("n_objs"), F.min("l_partkey").alias("first_obj"))


@query("sets_two_level", "SELECT l_returnflag, l_suppkey, l_partkey FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_returnflag, l_suppkey) >= 3")
def sets_two_level(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey").distinct()
    return sets.sets_to_frame(sets.frame_to_sets(rows, "l_suppkey", "l_partkey", 3, "l_returnflag"), "l_suppkey", "l_partkey")


CUSTOMERS = "SELECT c_nationkey AS set_id, c_custkey AS obj FROM customer"


@query("hypergeom_counts", f"""WITH m AS ({CUSTOMERS}), o AS (SELECT DISTINCT o_custkey AS obj FROM orders), r AS (SELECT c_custkey AS obj FROM customer WHERE c_acctbal > 5000),
  a AS (SELECT count(*) AS n FROM (SELECT obj FROM o UNION SELECT obj FROM r)), h AS (SELECT count(*) AS n FROM r)
  SELECT set_id, count(*) FILTER (o.obj IS NOT NULL AND r.obj IS NOT NULL) AS n_both, count(r.obj) AS n_ref, count(o.obj) AS n_obs, count(*) AS n_set, any_value(a.n) AS n_all, any_value(h.n) AS n_hit
  FROM m LEFT JOIN o ON m.obj = o.obj LEFT JOIN r ON m.obj = r.obj CROSS JOIN a CROSS JOIN h GROUP BY set_id""")
def hypergeom_counts(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    members = c.select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("obj"))
    return sets.set_counts(members, table(s, d, "orders").select(F.col("o_custkey").alias("obj")).distinct(), c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("obj")), "set_id", "obj")


@query("hypergeom_tail", """WITH c AS (SELECT c_nationkey AS set_id, count(*) FILTER (c_acctbal > 5000) AS k, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(k) AS m, sum(n) AS t FROM c),
  j AS (SELECT set_id, unnest(range(k, least(n, CAST(m AS BIGINT)) + 1)) AS i, n, m, t FROM c, t)
  SELECT set_id, round(log10(sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(t - m + 1) - lgamma(n - i + 1) - lgamma(t - m - n + i + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)))), 6) AS log10_p
  FROM j GROUP BY set_id""")
def hypergeom_tail(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("set_id")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("k"), F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("k").alias("m"), F.sum("n").alias("t")))
    return c.crossJoin(total).select("set_id", F.round(stats.hypergeom_log10_sf(F.col("k"), F.col("n"), F.col("m"), F.col("t")), 6).alias("log10_p"))


SCORES = "SELECT l_partkey AS term, l_suppkey AS sup, -sum(l_discount) * 40 AS score, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query("cascade_filter", f"""WITH x AS ({SCORES}), t AS (SELECT DISTINCT term FROM x WHERE score <= -6 AND n >= 2), u AS (SELECT DISTINCT sup FROM x WHERE score <= -6 AND n >= 2 AND term IN (SELECT term FROM t))
  SELECT term, sup, round(score, 6) AS score, n FROM x WHERE term IN (SELECT term FROM t) AND sup IN (SELECT sup FROM u) AND score <= 0""")
def cascade_filter(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("term"), F.col("l_suppkey").alias("sup")).agg((-F.sum("l_discount") * 40).alias("score"), F.count("*").alias("n"))
    return sets.filter_multicover(rows, ["term"], ["sup"], "score", "n", 1e-6).withColumn("score", F.round("score", 6))


@query("tighten_sets", f"""WITH x AS (SELECT l_suppkey AS sup, l_partkey AS part, round(-sum(l_discount) * 40, 6) AS score FROM lineitem GROUP BY 1, 2), b AS (SELECT sup, min(score) AS best FROM x GROUP BY sup),
  k AS (SELECT min(k) AS k FROM (SELECT unnest(range(0, 400)) AS k) WHERE (SELECT count(*) FROM b WHERE best <= -2 - k * 0.5) <= 40)
  SELECT x.sup, part, score FROM x JOIN b ON x.sup = b.sup, k WHERE best <= -2 - k * 0.5 AND score <= -1 - k * 0.5""")
def tighten_sets(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("part")).agg(F.round(-F.sum("l_discount") * 40, 6).alias("score"))
    return sets.tighten(rows, "sup", "score", -2.0, -1.0, 40)[0]


# --- strings


@query("url_group_parse", r"SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 1), '') AS scheme, nullif(regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 2), '') AS host, nullif(regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 3), '') AS path FROM pages")
def url_group_parse(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", *[extract_or_null(F.col("url"), r"^(https?)://([^/]+)(/.*)?$", k).alias(n) for k, n in ((1, "scheme"), (2, "host"), (3, "path"))])


@query("first_match_rewrite", "SELECT doc_id, CASE WHEN regexp_matches(source, '(?i)SRC1') THEN 'one' WHEN regexp_matches(source, '(?i)src2|src3') THEN 'few' ELSE source END AS canon FROM documents")
def first_match_rewrite(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", strings.first_rewrite(F.col("source"), (("SRC1", "one"), ("src2|src3", "few"))).alias("canon"))


@query("quality_penalty", r"""SELECT p_partkey, CAST(CASE WHEN gene IS NULL THEN 10 ELSE 0 END + coalesce(TRY_CAST(nullif(regexp_extract(ac, '^(\w+)-(?:PRO_)?(\d+)$', 2), '') AS INTEGER) - 1, 0) + CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 3 END + coalesce(ex, 7) - 1 AS INTEGER) AS penalty, regexp_replace(ac, '^(\w+)-(?:PRO_)?(\d+)$', '\1') AS ac
  FROM (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 > 0 THEN p_name END AS gene, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS ex, 'P' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '-' || p_size WHEN p_size % 7 = 0 THEN '-PRO_' || p_size ELSE '' END AS ac FROM part)""")
def quality_penalty(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    suffix = F.when(size % 2 == 0, F.concat(F.lit("-"), size)).when(size % 7 == 0, F.concat(F.lit("-PRO_"), size)).otherwise("")
    ac = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), suffix)
    db = F.when(F.col("p_brand") == "Brand#11", "sp").otherwise("tr")
    return table(s, d, "part").select("p_partkey", strings.rank_accession(ac, F.when(size % 3 > 0, F.col("p_name")), db, F.when(size % 5 > 0, size % 5)).cast("int").alias("penalty"), strings.strip_isoform(ac).alias("ac"))


@query("attribute_pivot", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, 'u' || user_id AS "user" FROM events""")
def attribute_pivot(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('; kind "'), F.col("event_type"), F.lit('"'))).otherwise("; broken")
    attrs = F.concat(F.lit('user "x"; user "u'), F.col("user_id").cast("string"), F.lit('"'), kind)
    a = table(s, d, "events").select("event_id", attribute_map(attrs).alias("a"))
    return a.select("event_id", F.element_at("a", "kind").alias("kind"), F.element_at("a", "user").alias("user"))


@query("flank_window", "SELECT p_partkey, substr('_____' || upper(p_name) || '_____', p_size % 7 + 1, 11) AS flank FROM part")
def flank_window(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", strings.flanking_sequence(F.col("p_name"), F.col("p_size") % 7 + 1, 5).alias("flank"))


@query("collapse_vals", "SELECT o_custkey, string_agg(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '; ' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY o_custkey")
def collapse_vals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(strings.collapse_values(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.col("o_orderkey")).alias("priorities"))


@query("axis_label_dedup", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) > 1 THEN c_mktsegment || '/' || c_nationkey || ' (' || c_custkey || ')' ELSE c_mktsegment || '/' || c_nationkey END AS label FROM customer")
def axis_label_dedup(s: SparkSession, d: str) -> DataFrame:
    named = table(s, d, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("n"))
    return strings.axis_labels(named, "c_custkey", ["n"]).select("c_custkey", "label")


# --- modified sequences


@query("residue_theta_join", """SELECT p_partkey, ptm_type, ptm_pos, ptm_AA FROM (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS ptm_pos, unnest(string_split(p_name, '')) AS ptm_AA FROM part)
  JOIN (VALUES ('Phospho', 'sty'), ('GlyGly', 'kc')) t(ptm_type, aas) ON contains(aas, ptm_AA)""")
def residue_theta_join(s: SparkSession, d: str) -> DataFrame:
    return ptm.ptm_sites(table(s, d, "part"), {"Phospho": "sty", "GlyGly": "kc"}, "p_partkey", "p_name")


TOKENS = "SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS w, p_size % 3 + 1 AS k FROM part"


@query("token_offsets", f"""SELECT p_partkey, w AS peptide_seq, 'Phospho' AS ptm_type, 'S' AS "ptm_AAs", substr(w, k, 1) AS "ptm_AA_seq", CAST(k - 1 AS BIGINT) AS ptm_offset, true AS is_selptm FROM ({TOKENS})
  UNION ALL SELECT p_partkey, w, 'Oxidation', 'M', substr(w, k + 2, 1), CAST(k + 1 AS BIGINT), false FROM ({TOKENS})""")
def token_offsets(s: SparkSession, d: str) -> DataFrame:
    w, k = F.regexp_replace("p_name", "[^a-z]", ""), F.col("p_size") % 3 + 1
    seq = F.concat(F.lit("_"), F.substring(w, F.lit(1), k), F.lit("(Phospho (S))"), F.substring(w, k + 1, F.lit(2)), F.lit("(Oxidation (M))"), F.substring(w, k + 3, F.lit(1000)), F.lit("_"))
    return ptm.extract_ptms(table(s, d, "part").select("p_partkey", seq.alias("pepmod_seq")), "maxquant", "p_partkey", selected="Phos")


@query("locprob_offsets", """SELECT p_partkey, p_size AS rawfile_ix, 'Phospho' AS ptm_type, substr(p_brand, 3, 1) AS "ptm_AA_seq", CAST(2 AS BIGINT) AS ptm_offset, CAST(0.75 AS DOUBLE) AS ptm_locprob FROM part
  UNION ALL SELECT p_partkey, p_size, 'Phospho', substr(p_brand, 5, 1), 4, CAST(0.25 AS DOUBLE) FROM part""")
def locprob_offsets(s: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    seq = F.concat(F.lit("_"), F.substring(b, 1, 3), F.lit("(0.75)"), F.substring(b, 4, 2), F.lit("(0.25)"), F.substring(b, 6, 9), F.lit("_"))
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").alias("rawfile_ix"), F.lit("Phospho").alias("ptm_type"), seq.alias("ptm_locprob_seq"))
    return ptm.extract_ptm_locprobs(rows, objid_col="p_partkey", report_col="p_partkey")


LISTS = "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ';' ORDER BY l_linenumber, l_suppkey) AS acs, string_agg(CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_quantity AS BIGINT), ';' ORDER BY l_linenumber, l_suppkey) AS poses FROM lineitem GROUP BY l_orderkey"


@query("parallel_list_zip", "SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS protein_ac, CAST(unnest([l_linenumber, CAST(l_quantity AS BIGINT)]) AS BIGINT) AS peptide_pos FROM lineitem")
def parallel_list_zip(s: SparkSession, d: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(x.alias("x"))
    acs = F.array_join(F.transform("x", lambda r: r["l_suppkey"].cast("string")), ";")
    poses = F.array_join(F.transform("x", lambda r: F.concat_ws(",", r["l_linenumber"].cast("string"), r["q"].cast("string"))), ";")
    return ptm.peptide_matches(rows.select("l_orderkey", acs.alias("protein_acs"), poses.alias("peptide_poses")), keys=["l_orderkey"])


@query("substring_occurrences", "SELECT doc_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT doc_id, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = 'and')) AS pos FROM documents) GROUP BY doc_id")
def substring_occurrences(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    found = docs.select("doc_id", F.explode(ptm.occurrences(F.col("text"), F.lit("and"))).alias("at"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


LINKS = "SELECT DISTINCT l_partkey AS prot, l_orderkey AS pep FROM lineitem"


def _links(s: SparkSession, d: str) -> DataFrame:
    """Orders are the peptides of parts."""
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("prot"), F.col("l_orderkey").alias("pep"))
    return rows.repartition(tasks(s, rows.count(), 1 << 20), "prot", "pep").distinct()


@query("identical_sets", "SELECT dense_rank() OVER (ORDER BY first) AS setgroup_id, prot FROM (SELECT prot, min(prot) OVER (PARTITION BY e) AS first FROM (SELECT l_partkey AS prot, list_sort(list_distinct(list(l_orderkey))) AS e FROM lineitem GROUP BY 1))")
def identical_sets(s: SparkSession, d: str) -> DataFrame:
    return ptm.set_groups(table(s, d, "lineitem").select(F.col("l_partkey").alias("prot"), F.col("l_orderkey").alias("pep")), "prot", "pep")


# --- proteins and graphs


@query("pair_relations", f"""WITH l AS ({LINKS}), c AS (SELECT a.prot AS id1, b.prot AS id2, count(*) AS n_common FROM l a JOIN l b ON a.pep = b.pep AND a.prot < b.prot GROUP BY 1, 2), n AS (SELECT prot, count(*) AS n FROM l GROUP BY 1)
  SELECT id1, id2, n_common, a.n - n_common AS n_left, b.n - n_common AS n_right FROM c JOIN n a ON a.prot = id1 JOIN n b ON b.prot = id2""")
def pair_relations(s: SparkSession, d: str) -> DataFrame:
    rows = _links(s, d)
    return proteins.pair_relations(rows, rows, "prot", "pep")


EQUIVALENT = "SELECT prot, min(prot) OVER (PARTITION BY e) AS rep FROM (SELECT prot, list_sort(list(pep)) AS e FROM l GROUP BY prot)"


@query("protein_equivalence", f"WITH l AS ({LINKS}) SELECT prot AS id, rep FROM ({EQUIVALENT})")
def protein_equivalence(s: SparkSession, d: str) -> DataFrame:
    rows = _links(s, d)
    return proteins.sharing_groups(proteins.pair_relations(rows, rows, "prot", "pep"), rows.select(F.col("prot").alias("id")))


@query("protein_groups", f"""WITH l AS ({LINKS}), e AS ({EQUIVALENT}), rp AS (SELECT rep, pep FROM l JOIN e ON l.prot = e.prot WHERE e.prot = rep),
  n AS (SELECT rep, count(*) AS n FROM rp GROUP BY 1), c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM rp a JOIN rp b ON a.pep = b.pep AND a.rep <> b.rep GROUP BY 1, 2),
  sub AS (SELECT c.a AS child, c.b AS parent FROM c JOIN n ON n.rep = c.a WHERE k = n), tops AS (SELECT DISTINCT rep FROM rp WHERE rep NOT IN (SELECT child FROM sub)),
  below AS (SELECT rep AS root, rep FROM tops UNION SELECT t.rep, sub.child FROM tops t JOIN sub ON sub.parent = t.rep),
  gp AS (SELECT DISTINCT root, prot FROM below JOIN e ON below.rep = e.rep), gq AS (SELECT DISTINCT root, pep FROM gp JOIN l ON gp.prot = l.prot),
  major AS (SELECT root, prot FROM gp QUALIFY count(*) OVER (PARTITION BY prot) = 1), spec AS (SELECT root, pep FROM gq QUALIFY count(*) OVER (PARTITION BY pep) = 1),
  kept AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS group_id FROM (SELECT DISTINCT root FROM spec))
  SELECT group_id, kind, item FROM kept JOIN (SELECT root, 'major' AS kind, CAST(prot AS VARCHAR) AS item FROM major UNION ALL SELECT root, 'prot', CAST(prot AS VARCHAR) FROM gp
  UNION ALL SELECT root, 'spec', CAST(pep AS VARCHAR) FROM spec UNION ALL SELECT root, 'pep', CAST(pep AS VARCHAR) FROM gq) x ON x.root = kept.root""")
def protein_groups(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("prot"), F.col("l_orderkey").alias("pep"), F.lit(1).alias("rank"))
    return proteins.assemble_protgroups(rows)


@query("components", """WITH e AS (SELECT o_orderkey * 3 AS a, o_custkey * 3 + 1 AS b FROM orders UNION ALL SELECT c_custkey * 3 + 1, c_nationkey * 3 + 2 FROM customer),
  n AS (SELECT o_orderkey * 3 AS id, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_custkey * 3 + 1, c_nationkey FROM customer UNION ALL SELECT DISTINCT c_nationkey * 3 + 2, c_nationkey FROM customer)
  SELECT id, min(id) OVER (PARTITION BY n) AS component FROM n""")
def components(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select((F.col("o_orderkey") * 3).alias("src"), (F.col("o_custkey") * 3 + 1).alias("dst"))
    customers = table(s, d, "customer").select((F.col("c_custkey") * 3 + 1).alias("src"), (F.col("c_nationkey") * 3 + 2).cast("long").alias("dst"))
    return graph.connected_components(orders.unionByName(customers))


@query("rollup_join_info", """SELECT l_suppkey AS protgroup_id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR)) AS parts, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS p_brand, bool_or(p_size > 45) AS big
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def rollup_join_info(s: SparkSession, d: str) -> DataFrame:
    groups = table(s, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").cast("string").alias("item")).distinct()
    groups = groups.withColumn("kind", F.lit("major"))
    info = table(s, d, "part").select(F.col("p_partkey").alias("ac"), "p_brand", (F.col("p_size") > 45).alias("big"))
    return proteins.group_table(groups, info=info, info_key="ac", extra_cols=["p_brand", "big"]).select("protgroup_id", F.col("majority_protein_acs").alias("parts"), "p_brand", "big")


@query("list_intersection", """SELECT a.p_partkey, nullif(array_to_string(list_sort(list_intersect(list_distinct(string_split(a.p_name, ' ')), string_split(b.p_name, ' '))), ';'), '') AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def list_intersection(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", ";").alias("a"))
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return pairs.select("p_partkey", proteins.intersect_lists(F.col("a"), F.col("b"), order=none).alias("common"))


@query("full_outer_chain", """WITH a AS (SELECT o_custkey AS k, string_agg(o_orderstatus, '; ' ORDER BY o_orderkey) AS x FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS y FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
  SELECT coalesce(a.k, b.k, c.c_custkey) AS k, x, y, c_mktsegment FROM a FULL JOIN b ON a.k = b.k FULL JOIN (SELECT c_custkey, c_mktsegment FROM customer) c ON c.c_custkey = coalesce(a.k, b.k)""")
def full_outer_chain(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    frames = {
        "a": o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("x"), F.col("o_orderkey").alias("row_ix")),
        "b": o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("y"), F.col("o_orderkey").alias("row_ix")),
        "c": table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"),
    }
    return proteins.combine_annotations(frames, {"a": ["x"], "b": ["y"]}, ["k"])


@query("group_matching", """WITH a AS (SELECT s_suppkey AS row_ix, 'A' || s_suppkey AS ac FROM supplier), b AS (SELECT s_suppkey AS row_ix, 'A' || s_suppkey AS ac FROM supplier WHERE s_acctbal > 0)
  SELECT z AS best_pg_rank, z AS worst_pg_rank, o AS best_ac_rank, o AS worst_ac_rank, a.row_ix AS rowix_a, b.row_ix AS rowix_b, z AS pgrank_a, o AS acrank_a, CASE WHEN b.row_ix IS NOT NULL THEN z END AS pgrank_b, CASE WHEN b.row_ix IS NOT NULL THEN o END AS acrank_b, a.ac AS majority_protein_acs, a.ac AS protein_acs
  FROM a LEFT JOIN b ON a.ac = b.ac, (SELECT CAST(0 AS BIGINT) AS z, CAST(1 AS BIGINT) AS o)""")
def group_matching(s: SparkSession, d: str) -> DataFrame:
    ac = F.concat(F.lit("A"), F.col("s_suppkey").cast("string"))
    a = table(s, d, "supplier").select("s_acctbal", F.col("s_suppkey").alias("row_ix"), ac.alias("majority_protein_acs"), ac.alias("protein_acs"))
    return proteins.match_protgroups({"a": a, "b": a.where("s_acctbal > 0")})


@query("run_metadata_join", "SELECT event_id, e.user_id, e.event_type AS event_type_orig, m.code AS event_type, m.grp FROM events e LEFT JOIN (SELECT user_id, user_id * 2 AS code, user_id % 3 AS grp FROM events WHERE value > 200 GROUP BY user_id) m ON e.user_id = m.user_id")
def run_metadata_join(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    runs = table(s, d, "events").where("value > 200").select("user_id").distinct().select("user_id", (F.col("user_id") * 2).alias("event_type"), (F.col("user_id") % 3).alias("grp"))
    return add_run_metadata(e, runs, ["event_type"], key="user_id")


@query("directed_edges", """SELECT gene1, gene2, score, direction, kind AS diedge_type, rev AS is_reverse FROM (SELECT s_name AS gene1, n_name AS gene2, s_acctbal AS score, s_suppkey % 3 AS direction, 't' AS kind, false AS rev FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 IN (0, 2)
  UNION ALL SELECT n_name, s_name, s_acctbal, s_suppkey % 3, 's', true FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 IN (1, 2))""")
def directed_edges(s: SparkSession, d: str) -> DataFrame:
    fi = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("gene1"), F.col("n_name").alias("gene2"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 3).alias("direction"))
    dirs = s.createDataFrame([(0, "s", "t", 1, 0), (1, "s", "t", 0, 1), (2, "s", "t", 1, 1)], "direction long, source string, target string, src_to_dest int, dest_to_src int")
    return network.directed_edges(fi, dirs)


@query("vertex_degrees", "SELECT vertex, CAST(sum(i) AS BIGINT) AS ninedges, CAST(sum(o) AS BIGINT) AS noutedges FROM (SELECT l_suppkey AS vertex, 0 AS i, 1 AS o FROM lineitem UNION ALL SELECT l_partkey, 1, 0 FROM lineitem) GROUP BY vertex")
def vertex_degrees(s: SparkSession, d: str) -> DataFrame:
    return network.vertex_degrees(table(s, d, "lineitem"), "l_suppkey", "l_partkey")


@query("walk_step", """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT src, sum(w) AS t FROM e GROUP BY 1)
  SELECT dst AS vertex, round(sum(p * w / t), 6) AS p FROM e JOIN t ON e.src = t.src JOIN (SELECT s_suppkey AS v, 1.0 AS p FROM supplier) m ON m.v = e.src GROUP BY dst""")
def walk_step(s: SparkSession, d: str) -> DataFrame:
    steps = network.transition(table(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    mass = table(s, d, "supplier").select(F.col("s_suppkey").alias("vertex"), F.lit(1.0).alias("p"))
    return network.walk_step(mass, steps).withColumn("p", F.round("p", 6))


# --- noise model and calibration

MODEL = noise.NoiseModel(0.7, 5.0, 1.2, 2.0, 0.99, 1.1, 0.4, -0.3, 0.2, 0.5, logintensityBase=2.0, outlierProb=1e-4)
_D = "((log2(value) - 5.0) * 0.7 - 0.2)"
LOGSTD = f"(0.5 * 1.5 * {_D} + 0.5 * 0.7000000000000001 * sqrt({_D} * {_D} + 0.5) + -0.3)"


@query("zscore_cols", "SELECT event_id, round((ln(value) - m) / s, 6) AS z FROM events, (SELECT avg(ln(value)) AS m, stddev_samp(ln(value)) AS s FROM events WHERE value > 0) WHERE value > 0")
def zscore_cols(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").where("value > 0").select("event_id", F.ln("value").alias("logintensity"))
    shift, scale = calib.z_parameters(rows)
    return rows.select("event_id", F.round((F.col("logintensity") - shift) * scale, 6).alias("z"))


@query("noise_std", f"SELECT event_id, round((log2(value) - 5.0) * 0.7, 6) AS z, round(pow(2.0, {LOGSTD}), 6) AS std, round(pow(2.0, -{LOGSTD}), 6) AS prec, round(pow(2.0, log2(value) - {LOGSTD}), 4) AS snr FROM events WHERE value > 0")
def noise_std(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(s, d, "events").where("value > 0").select("event_id", F.round(MODEL.zscore(v), 6).alias("z"), F.round(MODEL.signal_std(v), 6).alias("std"), F.round(MODEL.signal_precision(v), 6).alias("prec"), F.round(MODEL.signal_snr(v), 4).alias("snr"))


_T = "((value - 100) / 40)"


@query("mixture_logpdf", f"SELECT event_id, round(ln((1 - 1e-4) * exp(-{_T} * {_T} / 2) / sqrt(2 * pi()) + 1e-4 / (pi() * (1 + {_T} * {_T}))) - ln(40.0), 6) AS logpdf FROM events")
def mixture_logpdf(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.round(noise.GaussCauchyMix(100.0, 40.0).logpdf(F.col("value")), 6).alias("logpdf"))


_Z = f"(log2(value) * {MODEL.detection_factor} + {MODEL.detection_intercept})"


@query("loglik_sum", f"""SELECT event_type, round(sum(greatest(ln(1e-3), -ln(1 + exp(-{_Z})))), 4) AS detected, round(sum(greatest(ln(1e-3), -(greatest({_Z}, 0) + ln(1 + exp(-abs({_Z})))))), 4) AS missed FROM events WHERE value > 0 GROUP BY event_type""")
def loglik_sum(s: SparkSession, d: str) -> DataFrame:
    x = F.log2("value")
    seen, missed = (F.greatest(F.lit(calib.MIN_DETECT), MODEL.detection_loglik(F.lit(k), x)) for k in (True, False))
    return table(s, d, "events").where("value > 0").groupBy("event_type").agg(F.round(F.sum(seen), 4).alias("detected"), F.round(F.sum(missed), 4).alias("missed"))


@query("positive_or_null", "SELECT event_id, CASE WHEN value - 50 > 0 THEN value - 50 END AS x FROM events")
def positive_or_null(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", zero_to_null(F.col("value") - 50).alias("x"))


@query("run_ordinal_quantile", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) AS rank, round(row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type, user_id), 6) AS qtl FROM events")
def run_ordinal_quantile(s: SparkSession, d: str) -> DataFrame:
    rank, share = noise.quantile_rank("v", ["event_type", "user_id"])
    rows = table(s, d, "events").select("event_id", "event_type", "user_id", F.struct("value", "event_id").alias("v"))
    return rows.select("event_id", "event_type", rank.cast("long").alias("rank"), F.round(share, 6).alias("qtl"))


RUNS = "SELECT user_id AS obj, event_type AS run, max(value) AS x FROM events GROUP BY 1, 2"


@query("run_median_shift", f"""WITH r AS ({RUNS}), p AS (SELECT r.run, ln(r.x) / ln(2) - ln(f.x) / ln(2) AS shift, r.obj FROM r JOIN r f ON r.obj = f.obj AND f.run = (SELECT min(run) FROM r)),
  q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY shift) AS k, count(*) OVER (PARTITION BY run) AS n FROM p)
  SELECT run, round(median(shift), 6) AS logshift, max(n) AS npairs FROM q GROUP BY run""")
def run_median_shift(s: SparkSession, d: str) -> DataFrame:
    # with equal weights the weighted median is the median
    runs = table(s, d, "events").groupBy(F.col("user_id").alias("obj"), F.col("event_type").alias("run")).agg(F.max("value").alias("x"))
    first = F.broadcast(runs.agg(F.min("run").alias("f")))
    one = runs.crossJoin(first).where("run = f").select("obj", F.col("x").alias("x1"))
    pairs = runs.join(one, "obj").select("run", (F.log2("x") - F.log2("x1")).alias("shift"), F.lit(1.0).alias("w"))
    n = pairs.groupBy("run").agg(F.count("*").alias("npairs"))
    return stats.weighted_median(pairs, ["run"], "shift", "w", "logshift").join(n, "run").withColumn("logshift", F.round("logshift", 6))


@query("predicted_intensity", """WITH o AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), v AS (SELECT user_id, event_type, max(value) AS x FROM events GROUP BY 1, 2)
  SELECT o.user_id, round(median(x), 6) AS predicted, round(median(x) * pow(0.5, count(*) - count(x)), 6) AS corrected, count(*) - count(x) AS n_missing FROM o CROSS JOIN t LEFT JOIN v ON v.user_id = o.user_id AND v.event_type = t.event_type GROUP BY o.user_id""")
def predicted_intensity(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("msrun")).agg(F.max("value").alias("intensity")).withColumn("expchannel", F.lit("e")).withColumn("logintensity", F.log2("intensity"))
    shifts = v.select("expchannel", "msrun").distinct().withColumn("mult", F.lit(1.0))
    p = calib.predicted(calib.expanded(v, shifts, "user_id"), "user_id", 0.5)
    return p.select("user_id", F.round("intensity_norm_predicted", 6).alias("predicted"), F.round("intensity_norm_predicted_corr", 6).alias("corrected"), "n_missing")


GRID = "WITH q AS (SELECT floor(log2(quantile_cont(value, 0.005))) AS lo, ceil(log2(quantile_cont(value, 0.995))) AS hi FROM events WHERE value > 0), g AS (SELECT list(pow(2.0, lo + k * (hi - lo) / 19) ORDER BY k) AS g FROM q, range(0, 20) r(k))"


@query("log_bin_assign", f"{GRID} SELECT event_id, CAST(len(list_filter(g, lambda y: y < value)) + 1 AS INTEGER) AS bin FROM events, g")
def log_bin_assign(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", stats.grid_bin(F.col("value"), stats.quantile_grid(e, "value")).cast("int").alias("bin"))


@query("balanced_sample_sizes", f"""{GRID}, b AS (SELECT CAST(len(list_filter(g, lambda y: y < value)) + 1 AS INTEGER) AS bin FROM events, g), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), m AS (SELECT CAST(ceil(2 * quantile_cont(n, 0.1)) AS BIGINT) AS k FROM c)
  SELECT bin, least(n, k) AS n FROM c, m""")
def balanced_sample_sizes(s: SparkSession, d: str) -> DataFrame:
    binned = log_bin_assign(s, d).withColumnRenamed("bin", "intensity_bin")
    return calib.balanced_sample(binned, ["event_id"]).groupBy(F.col("intensity_bin").alias("bin")).agg(F.count("*").alias("n"))


@query("usable_objects", "SELECT user_id AS pepmodstate_id, bool_and(event_type IN ('click', 'view') OR value < 10) AS use_for_calib FROM events GROUP BY user_id HAVING min(value) > 1")
def usable_objects(s: SparkSession, d: str) -> DataFrame:
    obs = table(s, d, "events").select(F.col("user_id").alias("pepmodstate_id"), F.col("event_type").alias("ident_type"), F.when(F.col("value") >= 10, F.col("value")).alias("intensity"))
    objs = table(s, d, "events").groupBy(F.col("user_id").alias("pepmodstate_id")).agg((F.min("value") <= 1).alias("is_contaminant")).withColumn("is_reverse", F.lit(False))
    return calib.pepmodstate_data(obs, objs, allowed=["click", "view"]).select("pepmodstate_id", "use_for_calib")


@query("clamp_range_prep", "SELECT event_id, least(greatest(value, lo), hi) AS value FROM events e JOIN (SELECT event_type, 0.5 * min(user_id) AS lo, 2.0 * max(user_id) AS hi FROM events GROUP BY 1) b ON e.event_type = b.event_type")
def clamp_range_prep(s: SparkSession, d: str) -> DataFrame:
    return clamp_range(table(s, d, "events"), "user_id", ["value"], ["event_type"]).select("event_id", "value")
