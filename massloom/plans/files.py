"""Queries that write the driver's tables in a text format and read them back, and the graph and modification operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network, ptm, reshape
from ..session import fresh_path
from ..sources import texts, wide
from .registry import query, table


def _written(lines: DataFrame, name: str) -> str:
    """Path of a folder with the one string column of ``lines`` as text."""
    path = fresh_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def write_report(rows: DataFrame, head: list[str], cells: list[Column], path: str) -> None:
    """Files of tab-separated lines, each under the header."""
    lines = rows.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(h) for h, c in zip(head, cells, strict=True)])
    lines.write.options(header=True, sep="\t", emptyValue="").csv(path)


@query("fasta_round_trip", """SELECT CASE WHEN p_size % 2 = 0 THEN 'sp' ELSE 'tr' END AS src_db, 'P' || p_partkey AS protein_ac, 'C_' || p_size AS protein_code, p_name AS protein_name, p_type AS organism,
  CASE WHEN p_size % 3 > 0 THEN 'G' || p_size END AS genename, CAST(CASE WHEN p_size % 3 > 0 THEN p_size % 5 END AS INTEGER) AS protein_existence, upper(replace(p_name, ' ', '')) AS seq FROM part""")
def fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    more = F.when(size % 3 > 0, F.concat(F.lit(" GN=G"), size, F.lit(" PE="), size % 5)).otherwise("")
    head = F.concat(F.lit(">"), F.when(size % 2 == 0, "sp").otherwise("tr"), F.lit("|P"), "p_partkey", F.lit("|C_"), size, F.lit(" "), "p_name", F.lit(" OS="), "p_type", more)
    seq = F.upper(F.regexp_replace("p_name", " ", "\n"))
    path = _written(table(s, d, "part").select(F.concat(head, F.lit("\n"), seq)), "fasta")
    return texts.read_uniprot(s, path).select("src_db", "protein_ac", "protein_code", "protein_name", "organism", "genename", "protein_existence", "seq")


@query("gmt_round_trip", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS term_id, l_partkey AS obj_id, s_name AS name, 'GO_CC' AS src FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def gmt_round_trip(s: SparkSession, d: str) -> DataFrame:
    sets = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("objs")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    path = _written(sets.select(F.concat_ws("\t", F.concat_ws("%", "s_name", F.lit("gocc"), F.col("l_suppkey").cast("string")), F.lit("about"), F.array_join("objs", "\t"))), "gmt")
    info, members = texts.read_gmt(s, path, obj_type="long")
    return members.join(info, "term_id").select("term_id", "obj_id", "name", "src")


@query("gtf_round_trip", """SELECT 'chr' || p_size AS seqname, p_partkey AS start, p_partkey + p_size AS "end", 'G' || p_partkey AS gene_id, CASE WHEN p_size > 25 THEN p_brand END AS tag FROM part""")
def gtf_round_trip(s: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("p_size") > 25, F.concat(F.lit(' tag "first"; tag "'), "p_brand", F.lit('";'))).otherwise("")
    attrs = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('";'), tag)
    rows = table(s, d, "part").select(F.concat_ws("\t", F.concat(F.lit("chr"), "p_size"), F.lit("x"), F.lit("gene"), F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs))
    path = _written(rows.union(s.range(1).select(F.lit("#!version 1"))), "gtf")
    df = texts.read_gtf(s, path, None)
    return texts.parse_attributes(df, tags=["gene_id", "tag"]).select("seqname", "start", "end", "gene_id", "tag")


@query("report_round_trip", """SELECT p_partkey AS protgroup_id, p_name AS protein_acs, p_size % 4 = 0 AS is_reverse, p_size % 3 = 0 AS is_contaminant, CASE WHEN p_size % 5 > 0 THEN round(p_retailprice, 2) END AS ident_score,
  CASE WHEN p_size - 20 > 0 THEN CAST(p_size - 20 AS DOUBLE) END AS intensity, v AS msrun FROM part, (VALUES ('a'), ('b')) r(v)""")
def report_round_trip(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    plus = lambda c: F.when(c, "+").otherwise("")
    price = F.when(size % 5 > 0, F.format_string("%.2f", "p_retailprice")).otherwise("n. def.")
    head = ["id", "Protein IDs", "Reverse", "Potential contaminant", "Score", "Intensity a", "Intensity b"]
    cells = [F.col("p_partkey"), F.col("p_name"), plus(size % 4 == 0), plus(size % 3 == 0), price, size - 20, size - 20]
    path = fresh_path(s, "report")
    write_report(table(s, d, "part"), head, cells, path)
    df, _ = wide.read_wide_table(s, path, wide.PROTGROUPS, ["intensity"], wide.PROTGROUPS_NA)
    df = wide.cast_columns(df, {"protgroup_id": "long", "ident_score": "double"})
    return reshape.pivot_longer(df, ["protgroup_id", "protein_acs", "is_reverse", "is_contaminant", "ident_score"], r"^(?P<value>Intensity)\.(?P<var>.+)$", "msrun", {"Intensity": "intensity"})


@query("motif_headers", "SELECT 'n' || p_partkey AS protein_name, 'P' || p_partkey AS protein_ac, CAST(p_size AS BIGINT) AS start, CAST(p_size + 9 AS BIGINT) AS \"end\", p_brand AS motif_name, 'PS' || p_size AS motif_id, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS BIGINT) AS motif_start FROM part")
def motif_headers(s: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("PS"), "p_size", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), "p_size", F.lit("."), F.col("p_size") + 3)).otherwise(""))
    head = F.concat(F.lit(">n"), "p_partkey", F.lit("|P"), "p_partkey", F.lit("/"), "p_size", F.lit("-"), F.col("p_size") + 9, F.lit(": "), "p_brand", F.lit("|"), ref, F.lit("\nACD"))
    folder = fresh_path(s, "motifs")
    table(s, d, "part").select(head).write.text(f"{folder}/all.msa")
    m = texts.read_motif_alignments(s, folder)
    return m.select("protein_name", "protein_ac", "protein_range.start", "protein_range.end", "motif_name", "motif_id", F.col("motif_range.start").alias("motif_start"))


@query("evidence_parts", """SELECT 'peptides' AS part, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'pepmodstates', count(*) FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linenumber FROM lineitem)
  UNION ALL SELECT 'proteins', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'observations', count(*) FROM lineitem""")
def evidence_parts(s: SparkSession, d: str) -> DataFrame:
    acs = F.concat_ws(";", F.col("l_suppkey").cast("string"))
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("peptide_id"), F.col("l_partkey").cast("string").alias("peptide_seq"), F.col("l_returnflag").alias("pepmod_seq"), F.col("l_linenumber").alias("charge"), acs.alias("peptide_protein_acs"), F.lit("run").alias("msrun"), F.col("l_quantity").alias("intensity"))
    e = wide.decompose_evidence(wide.finish_evidence(rows))
    parts = {"peptides": e.peptides, "pepmodstates": e.pepmodstates, "proteins": e.peptide2protein, "observations": e.observations}
    out = None
    for name, part in parts.items():
        n = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("strong_components", """SELECT id, min(id) OVER (PARTITION BY c) AS component FROM (SELECT o_orderkey * 3 AS id, o_custkey * 3 + 1 AS c FROM orders UNION ALL SELECT c_custkey * 3 + 1, c_custkey * 3 + 1 FROM customer UNION ALL SELECT DISTINCT c_nationkey * 3 + 2, c_nationkey * 3 + 2 FROM customer)""")
def strong_components(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select((F.col("o_orderkey") * 3).alias("src"), (F.col("o_custkey") * 3 + 1).alias("dst"))
    c = table(s, d, "customer").select((F.col("c_custkey") * 3 + 1).alias("src"), (F.col("c_nationkey") * 3 + 2).cast("long").alias("dst"))
    return network.strong_components(o.unionByName(o.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(c).withColumn("w", F.lit(1.0)), 0.5)


@query("flow_edge_types", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'trace' ELSE 'interaction' END WHEN l_discount > 0.05 THEN 'walk' ELSE 'flow' END AS edge_type,
  round(-log10(least(l_tax + 0.01, 1.0)), 6) AS mlog10_p FROM lineitem WHERE l_suppkey <> l_partkey""")
def flow_edge_types(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_returnflag") == "R").alias("has_original"), F.lit(False).alias("has_original_rev"),
        (F.col("l_linestatus") == "F").alias("has_trace"), (F.col("l_discount") > 0.05).alias("has_walk"), F.lit(True).alias("has_flow"), (F.col("l_tax") + 0.01).alias("prob_perm_walkweight_greater"),
        F.lit(None).cast("double").alias("prob_perm_walkweight_greater_rev"),
    )
    return network.flow_edges(e, True).select("l_orderkey", "l_linenumber", "edge_type", F.round("mlog10_prob_perm_walkweight_greater", 6).alias("mlog10_p"))


@query("weighted_matrix", "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) * p_size AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey, p_size")
def weighted_matrix(s: SparkSession, d: str) -> DataFrame:
    walk = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return network.weighted_matrix(walk, table(s, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_size").cast("double").alias("weight")))


@query("ptm_grouping", "SELECT prot AS ptm_id, dense_rank() OVER (ORDER BY first) AS ptmgroup_id FROM (SELECT prot, min(prot) OVER (PARTITION BY e) AS first FROM (SELECT l_partkey AS prot, list_sort(list_distinct(list(l_orderkey))) AS e FROM lineitem GROUP BY 1))")
def ptm_grouping(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("ptm_id"), F.col("l_partkey").alias("ptmn_id"), F.lit("P").alias("ptm_type"), F.lit(1).alias("nselptms"), F.col("l_orderkey").alias("peptide_id"), F.col("l_orderkey").alias("pepmodstate_id"), F.lit(0).alias("ptm_offset"))
    return ptm.ptm_groups(rows)[0].select("ptm_id", "ptmgroup_id")


@query("level_round_trip", "SELECT c_custkey, c_mktsegment FROM customer")
def level_round_trip(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    levels = reshape.level_table(c, "c_mktsegment")
    return reshape.decode(reshape.encode(c, "c_mktsegment", levels, "code").drop("c_mktsegment"), "code", levels, "c_mktsegment").select("c_custkey", "c_mktsegment")


# SQL has no alignment: the mapping is tested against a brute-force score
@query("aligned_names")
def aligned_names(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_name").alias("protein_ac"), F.col("n_regionkey").alias("protgroup_id"), F.upper("n_name").alias("seq"))
    objs = n.select(F.col("protein_ac").alias("ptm_id"), "protein_ac", F.lit(2).alias("ptm_pos"))
    return ptm.map_positions(objs, n, n, "protgroup_id", self_matches=False).select("protein_ac", "agn_seqid", "agn_pos", "agn_match", "agn_score")
