"""Readers round trip, presets, labels, alignment, grouping, matching, filters and calibration, one query each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, stats, strings
from ..operators import calib, ids, matrices, network, noise, proteins, ptm, reshape, sets
from ..operators.align import blosum90
from ..session import fresh_path
from ..sources import columns, texts, wide
from .core import LOGSTD, MODEL
from .files import write_report
from .registry import query, table

# --- reports written and read back


def _report(rows: DataFrame, head: list[str], cells: list[Column], folder: str, name: str) -> None:
    write_report(rows, head, cells, f"{folder}/{name}")


def _plus(c: Column) -> Column:
    return F.when(c, "+").otherwise("")


@query("protgroups_preset", """SELECT p_partkey AS protgroup_id, p_name AS protein_acs, p_brand AS gene_names, p_size % 4 = 0 AS is_reverse, p_size % 3 = 0 AS is_contaminant, p_size % 5 = 0 AS is_site_only_ident,
  CASE WHEN p_size % 5 > 0 THEN round(p_retailprice, 2) END AS mol_weight_kda, p_size AS n_peptides, CASE WHEN p_size > 20 THEN CAST(p_size - 20 AS DOUBLE) END AS intensity_h, CASE WHEN p_size > 10 THEN CAST(p_size - 10 AS DOUBLE) END AS ibaq,
  CASE WHEN p_size > 30 THEN p_size / 10.0 END AS ratio, CASE WHEN p_size % 2 = 0 THEN 'By MS/MS' END AS ident_type FROM part""")
def protgroups_preset(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    head = ["id", "Protein IDs", "Gene names", "Reverse", "Potential contaminant", "Only identified by site", "Mol. weight [kDa]", "Peptides", "Intensity H r1", "iBAQ r1", "Ratio H/L r1", "Identification type r1", "other"]
    weight = F.when(size % 5 > 0, F.format_string("%.2f", "p_retailprice")).otherwise("NaN")
    cells = [F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), _plus(size % 4 == 0), _plus(size % 3 == 0), _plus(size % 5 == 0), weight, size, size - 20, size - 10, F.when(size > 30, size / 10), F.when(size % 2 == 0, "By MS/MS"), F.lit("x")]
    folder = fresh_path(s, "protgroups")
    _report(table(s, d, "part"), head, cells, folder, "proteinGroups.txt")
    df, _ = wide.read_protgroups(s, folder, ["intensity", "iBAQ", "ratio", "ident_type"])
    return df.select(
        "protgroup_id", "protein_acs", "gene_names", "is_reverse", "is_contaminant", "is_site_only_ident", F.col("mol_weight_kDa").alias("mol_weight_kda"), "n_peptides", F.col("`Intensity.r1|H`").alias("intensity_h"), F.col("`iBAQ.r1`").alias("ibaq"),
        F.col("`Ratio.H/L r1`").alias("ratio"), F.col("`ident_type.r1`").alias("ident_type"),
    )


@query("evidence_preset", """WITH e AS (SELECT (l_orderkey * 10 + l_linenumber) AS evidence_id, l_partkey AS peptide_id, 'K' || l_partkey AS peptide_seq, '_' || l_returnflag || '_' AS pepmod_seq, CAST(l_linenumber AS INTEGER) AS charge,
    l_linestatus AS rawfile, CASE WHEN l_quantity > 5 THEN l_quantity - 5 END AS intensity, CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 5 END AS ident_type_code FROM lineitem WHERE l_linestatus = 'F')
  SELECT evidence_id, peptide_seq, 'E_F' || '_F1' AS msrun, 'x' AS msexperiment_orig, intensity, ident_type_code, dense_rank() OVER (ORDER BY peptide_id, pepmod_seq) - 1 AS pepmod_id, dense_rank() OVER (ORDER BY peptide_id, pepmod_seq, charge) - 1 AS pepmodstate_id FROM e""")
def evidence_preset(s: SparkSession, d: str) -> DataFrame:
    head = ["Raw file", "Experiment", "Fraction", "id", "Intensity", "Type", "Peptide ID", "Sequence", "Modified sequence", "Charge"]
    kind = F.when(F.col("l_linenumber") % 2 == 0, "MSMS").otherwise("MULTI-MATCH")
    seen = F.when(F.col("l_quantity") > 5, F.col("l_quantity") - 5)
    rows = table(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    cells = [F.col("l_linestatus"), F.lit("x"), F.lit("1"), F.col("k"), seen, kind, F.col("l_partkey"), F.concat(F.lit("K"), "l_partkey"), F.concat(F.lit("_"), "l_returnflag", F.lit("_")), F.col("l_linenumber")]
    folder = fresh_path(s, "evidence")
    _report(rows, head, cells, folder, "evidence.txt")
    runs = s.createDataFrame([("F", "E_F", False), ("O", "E_O", True)], "rawfile string, msexperiment string, is_skipped boolean")
    df, _ = wide.read_evidence(s, folder, runs)
    return df.select("evidence_id", "peptide_seq", "msrun", "msexperiment_orig", "intensity", "ident_type_code", "pepmod_id", "pepmodstate_id")


@query("dia_preset", """SELECT 'P' || p_partkey AS protgroup_sn_id, p_brand AS gene_names, '_A' || p_size || '_.2' AS pepmodstate_seq, p_size % 2 = 0 AS is_decoy, r.ix AS rawfile_ix, r.raw AS rawfile,
  CASE WHEN r.ix = 1 THEN CAST(p_size AS VARCHAR) || '.5' WHEN p_size % 3 > 0 THEN CAST(floor(p_retailprice) AS INTEGER) || '' END AS quantity, CAST(p_size + r.ix AS VARCHAR) AS evidences FROM part, (VALUES (1, 'a.raw'), (2, 'b.raw')) r(ix, raw)""")
def dia_preset(s: SparkSession, d: str) -> DataFrame:
    """S4 with the scoped per-run columns, then to rows by run."""
    size = F.col("p_size")
    head = ["PG.ProteinGroups", "PG.Genes", "EG.PrecursorId", "EG.IsDecoy", "R.FileName", "[1] a.raw.PG.Quantity", "[2] b.raw.PG.Quantity", "[1] a.raw.PG.RunEvidenceCount", "[2] b.raw.PG.RunEvidenceCount", "Other"]
    cells = [F.concat(F.lit("P"), "p_partkey"), F.col("p_brand"), F.concat(F.lit("_A"), size, F.lit("_.2")), F.when(size % 2 == 0, "True").otherwise("False"), F.lit("f"), F.concat(size, F.lit(".5")), F.when(size % 3 > 0, F.floor("p_retailprice").cast("int").cast("string")).otherwise("Filtered"), size + 1, size + 2, F.lit("")]
    folder = fresh_path(s, "dia")
    _report(table(s, d, "part"), head, cells, folder, "report.tsv")
    df, _ = wide.read_dia_report(s, f"{folder}/report.tsv", ["quantity", "pepmodstate", "ident_stats"])
    keys = ["protgroup_sn_id", "gene_names", "pepmodstate_seq", "is_decoy"]
    long = reshape.pivot_runs_longer(df.select(*keys, *[F.col(f"`{c}`") for c in df.columns if c.startswith("PG_")]), keys)
    return long.select(*keys, "rawfile_ix", "rawfile", F.col("PG_intensity").alias("quantity"), F.col("PG_nevidences").alias("evidences"))


def _fasta(s: SparkSession, rows: DataFrame, head: Column, seq: Column) -> str:
    path = fresh_path(s, "fasta")
    rows.select(F.concat(F.lit(">"), head, F.lit("\n"), seq)).write.text(path)
    return path


@query("ensembl_round_trip", """SELECT 'ENSP' || p_partkey AS protein_ac, CASE WHEN p_size % 2 = 0 THEN 'known' ELSE 'novel' END AS status, 'chromosome' AS loctype, 'G:' || p_size || ':1' AS location, 'ENSG' || p_size AS gene_ac, 'ENST' || p_partkey AS transcript_ac,
  p_brand AS gene_biotype, p_type AS transcript_biotypes, upper(replace(p_name, ' ', '')) AS seq FROM part""")
def ensembl_round_trip(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    head = F.concat(F.lit("ENSP"), "p_partkey", F.lit("."), size, F.lit(" pep:"), F.when(size % 2 == 0, "known").otherwise("novel"), F.lit(" chromosome:G:"), size, F.lit(":1 gene:ENSG"), size, F.lit(" transcript:ENST"), "p_partkey", F.lit(" gene_biotype:"), "p_brand", F.lit(" transcript_biotype:"), "p_type")
    path = _fasta(s, table(s, d, "part"), head, F.upper(F.regexp_replace("p_name", " ", "\n")))
    return texts.read_ensembl(s, path).select("protein_ac", "status", "loctype", "location", "gene_ac", "transcript_ac", "gene_biotype", "transcript_biotypes", "seq")


@query("ensembl_variants", "SELECT 'ENSP' || p_partkey AS protein_ac, CASE WHEN p_size % 3 > 0 THEN 'A' || p_size || 'T;K9R' END AS saavs, 'MK' AS seq FROM part")
def ensembl_variants(s: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("ENSP"), "p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" A"), "p_size", F.lit("T;K9R"))).otherwise(""))
    return texts.read_ensembl(s, _fasta(s, table(s, d, "part"), head, F.lit("MK")), False, True).select("protein_ac", F.col("SAAVs").alias("saavs"), "seq")


@query("contaminants_round_trip", """SELECT CASE p_size % 3 WHEN 0 THEN 'CON__P' || p_partkey WHEN 1 THEN 'Q' || p_partkey END AS protein_ac, CASE p_size % 3 WHEN 0 THEN 'SWISS-PROT' WHEN 1 THEN 'TREMBL' END AS src_db,
  CASE WHEN p_size % 3 < 2 AND p_size % 2 = 0 THEN p_brand END AS organism, CASE WHEN p_size % 3 < 2 THEN p_name END AS protein_name, 'MA' AS seq FROM part""")
def contaminants_round_trip(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    organism = F.when(size % 2 == 0, F.concat(F.lit("("), "p_brand", F.lit(") "))).otherwise("")
    one = F.concat(F.lit("CON__P"), "p_partkey", F.lit(" SWISS-PROT:P"), "p_partkey", F.lit("|"), organism, "p_name")
    two = F.concat(F.lit("CON__TREMBL:Q"), "p_partkey", F.lit(" "), organism, "p_name")
    path = _fasta(s, table(s, d, "part"), F.when(size % 3 == 0, one).when(size % 3 == 1, two).otherwise(F.lit("zzz")), F.lit("MA"))
    return texts.read_contaminants(s, path).select("protein_ac", "src_db", "organism", "protein_name", "seq")


@query("site_fasta_round_trip", "SELECT CASE WHEN p_size % 2 = 0 THEN p_brand END AS genename, p_name AS protein_name, 'human' AS organism, 'P' || p_partkey AS protein_ac, 'MSD' AS seq FROM part")
def site_fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("GN:"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("-"), F.lit("|"), "p_name", F.lit("|human|P"), "p_partkey")
    return texts.read_site_fasta(s, _fasta(s, table(s, d, "part"), head, F.lit("MSD"))).select("genename", "protein_name", "organism", "protein_ac", "seq")


@query("site_annotations", """SELECT 'PhosphoSites' AS name, 'P' || p_partkey AS protein_ac, 'S' AS "ptm_AA", p_size AS ptm_pos, 'p' AS ptm_code, p_brand AS gene_name FROM part
  UNION ALL SELECT 'KinaseSubstrate', 'P' || p_partkey, 'T', p_size, NULL, CASE WHEN p_size % 2 = 0 THEN 'sub' END FROM part""")
def site_annotations(s: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(s, "sites")
    part = table(s, d, "part")
    for name, file in texts.SITE_FILES.items():
        kinase = name == "KinaseSubstrate"
        head = ["SUB_ACC_ID", "SUB_MOD_RSD", "GENE", "SUB_GENE"] if kinase else ["ACC_ID", "MOD_RSD", "GENE", "ORGANISM"]
        cells = [F.concat(F.lit("P"), "p_partkey"), F.concat(F.lit("T" if kinase else "S"), "p_size", F.lit("" if kinase else "-p")), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "sub")]
        lines = s.createDataFrame([(-4, "date"), (-3, "licence"), (-2, ""), (-1, "\t".join(head))], "k long, value string")
        own = part.select(F.col("p_partkey").alias("k"), F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("value"))
        lines.union(own).repartition(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/{file}")
    got = texts.read_site_annotations(s, folder)
    pick = lambda name, gene: got[name].select(F.lit(name).alias("name"), "protein_ac", "ptm_AA", F.col("ptm_pos").cast("int").alias("ptm_pos"), ("ptm_code" if "ptm_code" in got[name].columns else F.lit(None).cast("string").alias("ptm_code")), gene)
    return pick("PhosphoSites", F.col("gene_name")).unionByName(pick("KinaseSubstrate", F.col("gene_name")))


@query("set_collections", "SELECT DISTINCT 'Hs_SigDB_' || l_returnflag AS coll_id, 'S' || l_suppkey AS set_id, l_partkey AS obj_id FROM lineitem WHERE l_returnflag <> 'N'")
def set_collections(s: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(s, "collections")
    rows = table(s, d, "lineitem").select("l_returnflag", F.concat(F.lit("S"), "l_suppkey").alias("set_id"), F.col("l_partkey").alias("obj_id"))
    for name in "AR":
        rows.where(F.col("l_returnflag") == name).drop("l_returnflag").write.parquet(f"{folder}/{name}")
    return texts.read_set_collections(s, {"A": f"{folder}/A", "R": f"{folder}/R"})


@query("network_reader", """SELECT s_name AS gene1, n_name AS gene2, round(s_acctbal, 2) AS score, CASE WHEN s_suppkey % 2 = 0 THEN '->' ELSE '<->' END AS direction, CASE WHEN s_suppkey % 2 = 0 THEN 't' ELSE 'v' END AS diedge_type, false AS is_reverse FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, s_name, round(s_acctbal, 2), '<->', 'u', true FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1""")
def network_reader(s: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(s, "network")
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    _report(rows, ["Gene1", "Gene2", "Direction", "Score"], [F.col("s_name"), F.col("n_name"), F.when(F.col("s_suppkey") % 2 == 0, "->").otherwise("<->"), F.format_string("%.2f", "s_acctbal")], folder, "fi")
    ways = s.createDataFrame([(0, "->", "s", "t", 1, 0), (1, "<->", "u", "v", 1, 1)], "k long, d string, s string, t string, f int, r int")
    _report(ways, ["direction", "source", "target", "src_to_dest", "dest_to_src"], [F.col(c) for c in ("d", "s", "t", "f", "r")], folder, "ways")
    return texts.read_network(s, f"{folder}/fi", f"{folder}/ways")


@query("graph_file", """SELECT 'node' AS kind, 'v' || s_suppkey AS a, 'g' || s_nationkey AS b, CASE WHEN s_suppkey % 6 = 0 THEN 'source/sink' WHEN s_suppkey % 2 = 0 THEN 'source' WHEN s_suppkey % 3 = 0 THEN 'sink' WHEN s_suppkey % 5 = 0 THEN 'step' ELSE 'gene' END AS label FROM supplier
  UNION ALL SELECT 'edge', 'v' || s_suppkey, 'v' || (s_suppkey + 1), CASE WHEN s_suppkey % 2 = 0 THEN 'interaction' ELSE 'flow' END FROM supplier""")
def graph_file(s: SparkSession, d: str) -> DataFrame:
    """Written as a graph file and read back by its tags."""
    vertices, edges = _flow_frames(s, d)
    none = F.lit(None).cast("double")
    rows = edges.withColumns({"has_trace": F.lit(False), "has_walk": F.lit(False), "has_flow": F.lit(True), "prob_perm_walkweight_greater": none, "prob_perm_walkweight_greater_rev": none})
    nodes, links = network.graph_frames(network.flow_vertices(vertices, component_groups=False), network.flow_edges(rows, True))
    path = fresh_path(s, "graphml")
    network.write_graphml(nodes, links, path)
    lines = s.read.text(path)
    got = lambda pattern: F.regexp_extract("value", pattern, 1)
    node = lines.where("value like '<node %'").select(F.lit("node").alias("kind"), got('id="([^"]+)"').alias("a"), got('key="node_parent">([^<]+)<').alias("b"), got('key="node_vertex_type">([^<]+)<').alias("label"))
    edge = lines.where("value like '<edge %'").select(F.lit("edge").alias("kind"), got('source="([^"]+)"').alias("a"), got('target="([^"]+)"').alias("b"), got('key="edge_edge_type">([^<]+)<').alias("label"))
    return node.unionByName(edge)


@query("calibration_frames", f"""WITH u AS (SELECT user_id AS obj, event_type AS msrun, max(value) AS x FROM events GROUP BY 1, 2), r AS (SELECT DISTINCT msrun FROM u), n AS (SELECT count(*) AS n FROM r)
  SELECT msrun, CAST(count(*) AS BIGINT) AS npairs FROM u WHERE obj IN (SELECT obj FROM u WHERE msrun = (SELECT min(msrun) FROM r) AND x > 0) AND x > 0 GROUP BY msrun""")
def calibration_frames(s: SparkSession, d: str) -> DataFrame:
    """Q3 by kind, saved and loaded: the pairs that each run's shift is made of."""
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("pepmodstate_id"), F.col("event_type").alias("msrun")).agg(F.max("value").alias("intensity")).withColumn("ident_type", F.lit("MSMS"))
    objects = rows.select("pepmodstate_id").distinct().withColumns({"is_contaminant": F.lit(False), "is_reverse": F.lit(False)})
    channels = rows.select("msrun").distinct().withColumn("experiment", F.lit("e"))
    data = calib.calibration_data_of("pepmodstate", {"observations": rows, "pepmodstates": objects}, channels)
    folder = fresh_path(s, "calibration")
    calib.save_data(data, folder)
    return calib.load_data(s, folder).shifts.select("msrun", "npairs")


@query("model_dict_round_trip", "SELECT event_id, round((log2(value) - 5.0) * 0.7, 6) AS z FROM events WHERE value > 0")
def model_dict_round_trip(s: SparkSession, d: str) -> DataFrame:
    model = noise.NoiseModel.from_dict(MODEL.to_dict())
    return table(s, d, "events").where("value > 0").select("event_id", F.round(model.zscore(F.col("value")), 6).alias("z"))


@query("calibration_prefix", "SELECT s_suppkey, 'mscalib_' || s_name || '_LFQ_protgroup_' || s_nationkey || '_v1' AS prefix FROM supplier")
def calibration_prefix(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", calib.file_prefixes(F.col("s_name"), F.lit("LFQ"), F.lit("protgroup"), F.col("s_nationkey"), F.lit("v1")).alias("prefix"))


# --- columns of reports


# names of a report's columns as rows, one for each customer


@query("msrun_columns", """SELECT c_custkey, colname, regexp_extract(colname, '^([^.|]+)', 1) AS measure, nullif(regexp_extract(colname, '^[^.|]+\\.([^|]*)', 1), '') AS msrun, nullif(regexp_extract(colname, '\\|(.+)$', 1), '') AS mstag
  FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Intensity.' || c_name || '|H' WHEN 1 THEN 'iBAQ.' || c_name ELSE 'LFQ_Intensity.' END AS colname FROM customer)""")
def msrun_columns(s: SparkSession, d: str) -> DataFrame:
    r = F.col("c_nationkey") % 3
    name = F.when(r == 0, F.concat(F.lit("Intensity."), "c_name", F.lit("|H"))).when(r == 1, F.concat(F.lit("iBAQ."), "c_name")).otherwise("LFQ_Intensity.")
    return columns.parsed_names(table(s, d, "customer").select("c_custkey", name.alias("colname")), columns.MSRUN)


@query("ratio_columns", """SELECT c_custkey, colname, 'H' AS nom, 'L' AS denom, CASE WHEN colname LIKE '% normalized %' THEN 'normalized' WHEN colname LIKE '% count %' THEN 'count' END AS measure, regexp_extract(colname, '(\\S+)$', 1) AS sample
  FROM (SELECT c_custkey, 'Ratio.H/L ' || CASE c_nationkey % 3 WHEN 0 THEN 'normalized ' WHEN 1 THEN 'count ' ELSE '' END || 's' || c_custkey AS colname FROM customer)""")
def ratio_columns(s: SparkSession, d: str) -> DataFrame:
    r = F.col("c_nationkey") % 3
    name = F.concat(F.lit("Ratio.H/L "), F.when(r == 0, "normalized ").when(r == 1, "count ").otherwise(""), F.lit("s"), "c_custkey")
    return columns.parsed_names(table(s, d, "customer").select("c_custkey", name.alias("colname")), columns.RATIO)


@query("metrics_columns", """SELECT c_custkey, (CASE c_nationkey % 2 WHEN 0 THEN 'PG_' ELSE '' END) || 'intensity.[' || c_custkey || '] ' || c_name || '.raw' AS colname, CASE c_nationkey % 2 WHEN 0 THEN 'PG' END AS scope, 'intensity' AS measure,
  CAST(c_custkey AS INTEGER) AS rawfile_ix, c_name || '.raw' AS rawfile FROM customer""")
def metrics_columns(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "PG_").otherwise(""), F.lit("intensity.["), "c_custkey", F.lit("] "), "c_name", F.lit(".raw"))
    return columns.parsed_names(table(s, d, "customer").select("c_custkey", name.alias("colname")), columns.METRICS)


@query("ratio_and_type_columns", """SELECT p_partkey, CASE WHEN p_size - 20 > 0 THEN CAST(p_size - 20 AS DOUBLE) END AS ratio, p_brand AS ratio_type, CASE WHEN p_size % 2 = 0 THEN p_type END AS ident FROM part""")
def ratio_and_type_columns(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", columns.fix_ratio(size - 20, "Ratio.H/L").alias("ratio"), columns.fix_ratio(F.col("p_brand"), "Ratio.H/L type").alias("ratio_type"), columns.fix_ident_type(F.when(size % 2 == 0, F.col("p_type")).otherwise(""), "ident_type.r").alias("ident"))


@query("scoped_columns", """SELECT old, "new" FROM (VALUES ('[1] a.raw.PG.Quantity', 'PG_intensity.[1] a.raw'), ('[2] b.raw.PEP.Quantity', 'PEP_intensity.[2] b.raw'), ('[3] c.raw.EG.Qvalue', 'EG_qvalue.[3] c.raw'), ('PG.IsSingleHit', 'PG_is_singlehit')) t(old, "new") WHERE (SELECT count(*) FROM region) > 0""")
def scoped_columns(s: SparkSession, d: str) -> DataFrame:
    own = columns.ColumnGroup("x", columns.scoped((r"\.Quantity", "intensity"), (r"\.Qvalue", "qvalue"), ("IsSingleHit", "is_singlehit")))
    names = ["[1] a.raw.PG.Quantity", "[2] b.raw.PEP.Quantity", "[3] c.raw.EG.Qvalue", "PG.IsSingleHit", "R.Other"]
    return s.createDataFrame(own.names(names), "old string, new string")


# --- surrogate ids and categories


@query("protgroup_ids", "SELECT p_partkey, p_brand AS majority_protein_acs, dense_rank() OVER (ORDER BY p_type) AS protgroup_id FROM part")
def protgroup_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("majority_protein_acs_alt"), F.col("p_type").alias("protgroup_sn_id"))
    return ids.update_protgroups(rows).select("p_partkey", "majority_protein_acs", "protgroup_id")


@query("peptide_ids", "SELECT p_partkey, p_brand AS peptide_seq, dense_rank() OVER (ORDER BY p_brand) AS peptide_id FROM part")
def peptide_ids(s: SparkSession, d: str) -> DataFrame:
    seq = F.concat(F.substring("p_brand", 1, 3), F.lit("[Phospho (STY)]"), F.substring("p_brand", 4, 20), F.lit("[x]"))
    return ids.update_peptides(table(s, d, "part").select("p_partkey", seq.alias("pepmod_seq"))).select("p_partkey", "peptide_seq", "peptide_id")


@query("pepmodstates_in_order", """WITH e AS (SELECT event_id, event_type AS m, event_type || '.' || user_id % 4 AS st, CAST(user_id % 4 AS INTEGER) AS charge FROM events)
  SELECT event_id, a.ix AS pepmod_id, b.ix AS pepmodstate_id, charge FROM e JOIN (SELECT m, row_number() OVER (ORDER BY min(event_id)) - 1 AS ix FROM e GROUP BY m) a ON a.m = e.m JOIN (SELECT st, row_number() OVER (ORDER BY min(event_id)) - 1 AS ix FROM e GROUP BY st) b ON b.st = e.st""")
def pepmodstates_in_order(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", F.col("event_type").alias("pepmod_seq"), F.concat_ws(".", "event_type", (F.col("user_id") % 4).cast("string")).alias("pepmodstate_seq"))
    return ids.update_pepmodstates_by_order(rows, "event_id").select("event_id", "pepmod_id", "pepmodstate_id", "charge")


@query("matched_levels", "SELECT o_orderkey, CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS BIGINT) AS code FROM orders")
def matched_levels(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    own = {"o_orderpriority": reshape.level_table(orders, "o_orderpriority"), "other": reshape.level_table(orders, "o_orderpriority")}
    backward = reshape.level_table(orders, "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return reshape.encode(orders, "o_orderpriority", reshape.match_levels(own, {"o_orderpriority": backward}, ["o_orderpriority"])["o_orderpriority"], "code").select("o_orderkey", "code")


@query("nonnull_columns", "SELECT p_partkey, p_name FROM part")
def nonnull_columns(s: SparkSession, d: str) -> DataFrame:
    return nulls.assert_no_null_keys(reshape.to_nonnull(table(s, d, "part").select("p_partkey", "p_name"), ["p_name"]), ["p_partkey"])


@query("ptm_columns_longer", """SELECT p_partkey, 'Phospho (STY)' AS ptm_type, p_size AS ptm_ids, p_name AS ptm_locprob_seq FROM part UNION ALL SELECT p_partkey, 'Gly.Gly (K)', p_size + 1, p_type FROM part""")
def ptm_columns_longer(s: SparkSession, d: str) -> DataFrame:
    wide_ = table(s, d, "part").select("p_partkey", F.col("p_size").alias("ptm_ids.Phospho (STY)"), F.col("p_name").alias("ptm_locprob_seq.Phospho (STY)"), (F.col("p_size") + 1).alias("ptm_ids.Gly.Gly (K)"), F.col("p_type").alias("ptm_locprob_seq.Gly.Gly (K)"))
    return reshape.pivot_ptms_longer(wide_, ["p_partkey"])


@query("tuple_keys", "SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand, p_type")
def tuple_keys(s: SparkSession, d: str) -> DataFrame:
    keyed = table(s, d, "part").where("p_size > 10").select(reshape.tuple_col("p_brand", "p_type").alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("n")).select("k.p_brand", "k.p_type", "n")


@query("axis_table", "SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) AS ix FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def axis_table(s: SparkSession, d: str) -> DataFrame:
    return reshape.axis_frame(table(s, d, "part"), ["p_brand", "p_type"], "ix")


# --- labels


@query("minus_is_null", "SELECT p_partkey, nullif(x, '-') AS x FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '-' ELSE p_brand END AS x FROM part)")
def minus_is_null(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", nulls.minus_to_null(F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_brand"))).alias("x"))


@query("ptm_labels", "SELECT p_partkey, 'Phospho_' || coalesce(CASE WHEN p_size % 3 > 0 THEN p_brand END, 'Unknown') || CASE WHEN p_size % 2 = 0 THEN '-' || p_size ELSE '' END || '_S' || p_size AS label FROM part")
def ptm_labels(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", strings.ptm_label(F.lit("Phospho"), F.when(size % 3 > 0, F.col("p_brand")), F.lit("S"), size, F.when(size % 2 == 0, size)).alias("label"))


@query("escaped_arrows", "SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def escaped_arrows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", strings.escape_arrows(F.col("html")).alias("html"))


@query("flow_labels", """SELECT l_orderkey, string_agg(coalesce(p_brand, CAST(l_partkey AS VARCHAR)) || '(' || n || ')', ' ' ORDER BY l_partkey) AS label FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def flow_labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "p_brand")).alias("x"))
    return rows.select("l_orderkey", strings.flow_label(F.col("x.l_partkey"), F.col("x.p_brand")).alias("label"))


@query("styled_contrasts", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '<b>F</b> vs ' || CASE o_orderstatus WHEN 'F' THEN '<b>F</b>' WHEN 'O' THEN '<i>O</i>' ELSE o_orderstatus END || CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '' END ELSE o_orderstatus END AS contrast,
  CASE o_orderstatus WHEN 'F' THEN '<b>F</b>' WHEN 'O' THEN '<i>O</i>' ELSE o_orderstatus END AS own FROM orders""")
def styled_contrasts(s: SparkSession, d: str) -> DataFrame:
    styles = {"F": "<b>F</b>", "O": "<i>O</i>"}
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    raw = F.when(key % 3 == 0, F.concat(F.lit("F_vs_"), status, F.when(key % 2 == 0, "+").otherwise(""))).otherwise(status)
    return table(s, d, "orders").select("o_orderkey", strings.stylize_contrast(raw, styles).alias("contrast"), strings.stylize(status, styles).alias("own"))


@query("replaced_labels", "SELECT p_partkey, replace(replace(p_type, 'STEEL', 'iron'), 'iron', 'Fe') AS label FROM part")
def replaced_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", strings.replace_chain(F.col("p_type"), [("STEEL", "iron"), ("iron", "Fe")]).alias("label"))


@query("plain_labels", "SELECT p_partkey, p_brand || ' ' || p_type AS plain, CAST(2 AS INTEGER) AS n_lines, p_type AS last FROM part")
def plain_labels(s: SparkSession, d: str) -> DataFrame:
    lines = strings.label_lines(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "<br>\n").otherwise("\n"), "p_type"))
    marked = strings.plain_label(F.concat(F.lit("<b>"), "p_brand", F.lit('</b> <span a="1">'), "p_type", F.lit("</span>")))
    return table(s, d, "part").select("p_partkey", marked.alias("plain"), F.size(lines).alias("n_lines"), F.element_at(lines, -1).alias("last"))


@query("axis_tooltips", "SELECT p_partkey, 'brand: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '<br>size: ' || p_size ELSE '' END AS tooltip, count(*) OVER (PARTITION BY p_brand) > 1 AS is_shared FROM part")
def axis_tooltips(s: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", strings.axis_tooltip(brand=F.col("p_brand"), size=size).alias("tooltip"), strings.duplicate_flag("p_brand").alias("is_shared"))


# --- modified sequences


@query("peptide_search", """SELECT p_partkey, 'A' || p_partkey AS protein_ac, CAST(unnest(list_filter(range(1, length(w) + 1), lambda i: substr(w, i, 2) = substr(w, 2, 2) AND NOT (i > 1 AND substr(w, i - 1, 2) = substr(w, 2, 2)))) AS BIGINT) AS peptide_pos FROM (SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS w FROM part) WHERE substr(w, 2, 1) <> substr(w, 3, 1)""")
def peptide_search(s: SparkSession, d: str) -> DataFrame:
    """Two residues that differ cannot overlap themselves."""
    w = table(s, d, "part").select("p_partkey", F.regexp_replace("p_name", "[^a-z]", "").alias("seq")).where("substr(seq, 2, 1) <> substr(seq, 3, 1)")
    ac = F.concat(F.lit("A"), "p_partkey")
    peptides = w.select("p_partkey", F.concat(F.lit("_"), F.substring("seq", 2, 2), F.lit("_")).alias("peptide_seq"), F.concat(ac, F.lit(";none")).alias("protein_acs"))
    return ptm.match_peptides(peptides, w.select(ac.alias("protein_ac"), "seq"), keys=["p_partkey"])


_SEQS = "SELECT s_suppkey AS ac, s_nationkey AS g, 'MKWVTFISLLFLFSSAYSRG' AS base, CAST(s_suppkey % 17 + 2 AS INTEGER) AS spot FROM supplier"


def _variants(s: SparkSession, d: str) -> DataFrame:
    """Sequences of one length that differ from their family's in one residue: their best alignment has no gap."""
    base, spot = F.lit("MKWVTFISLLFLFSSAYSRG"), (F.col("s_suppkey") % 17 + 2).cast("int")
    seq = F.concat(F.substring(base, F.lit(1), spot - 1), F.lit("H"), F.substring(base, spot + 1, F.lit(20)))
    return table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("protein_ac"), F.col("s_nationkey").alias("protgroup_id"), seq.alias("seq"), spot.alias("spot"), F.lit(1).alias("seq_rank"))


@query("aligned_positions", f"""WITH v AS ({_SEQS}), w AS (SELECT ac, g, spot, substr(base, 1, spot - 1) || 'H' || substr(base, spot + 1) AS seq FROM v)
  SELECT CAST(a.ac AS VARCHAR) AS protein_ac, CAST(b.ac AS VARCHAR) AS agn_seqid, a.spot AS ptm_pos, a.spot AS agn_pos, substr(b.seq, a.spot, 1) AS "agn_AA", CASE WHEN substr(b.seq, a.spot, 1) = 'H' THEN '=' ELSE 'X' END AS agn_match, a.spot AS agn_column, CAST(20 AS BIGINT) AS agn_len,
  CAST(CASE WHEN a.spot = b.spot THEN 1.0 ELSE 0.9 END AS DOUBLE) AS agn_match_ratio FROM w a JOIN w b ON a.g = b.g""")
def aligned_positions(s: SparkSession, d: str) -> DataFrame:
    v = _variants(s, d)
    objs = v.select(F.col("protein_ac").alias("ptm_id"), "protein_ac", F.col("spot").alias("ptm_pos"))
    got = ptm.map_positions(objs, v, v, "protgroup_id")
    return got.select("protein_ac", "agn_seqid", "ptm_pos", "agn_pos", "agn_AA", "agn_match", "agn_column", "agn_len", F.round("agn_match_ratio", 6).alias("agn_match_ratio"))


@query("grouped_objects", f"""WITH v AS ({_SEQS}), w AS (SELECT ac, g, spot FROM v), f AS (SELECT g, spot, min(ac) AS first FROM w GROUP BY 1, 2), r AS (SELECT g, spot, min(CAST(ac AS VARCHAR)) AS ref FROM w GROUP BY 1, 2)
  SELECT CAST(w.ac AS VARCHAR) AS protein_ac, CAST(w.spot AS BIGINT) AS ptm_pos, CAST(w.ac AS VARCHAR) = r.ref AS is_reference, 'Phospho_' || w.g || '_H' || w.spot AS ptm_label FROM w JOIN r ON w.g = r.g AND w.spot = r.spot""")
def grouped_objects(s: SparkSession, d: str) -> DataFrame:
    """Sequences of a family that have the changed residue at the same place hold one object."""
    v = _variants(s, d)
    objs = v.select(F.lit("Phospho").alias("ptm_type"), "protein_ac", F.col("spot").alias("ptm_pos"), F.lit("H").alias("ptm_AA"))
    return ptm.group_objects(objs, v).select("protein_ac", "ptm_pos", "is_reference", "ptm_label")


_STATES = "SELECT DISTINCT l_partkey AS ptm, l_partkey * 2 + l_linenumber % 2 AS ptmn, l_orderkey AS pep, l_orderkey * 2 + l_linenumber % 2 AS pms FROM lineitem"


@query("ptm_grouping_merged", f"""WITH RECURSIVE l AS ({_STATES}), p AS (SELECT ptm, list_sort(list_distinct(list(pep))) AS e FROM l GROUP BY 1), q AS (SELECT ptmn, list_sort(list_distinct(list(pms))) AS e FROM l GROUP BY 1),
  pg AS (SELECT ptm, min(ptm) OVER (PARTITION BY e) AS g FROM p), qg AS (SELECT ptmn, min(ptmn) OVER (PARTITION BY e) AS g FROM q),
  b AS (SELECT DISTINCT pg.g AS a, qg.g AS c FROM l JOIN pg ON l.ptm = pg.ptm JOIN qg ON l.ptmn = qg.ptmn), x AS (SELECT DISTINCT b1.a AS u, b2.a AS v FROM b b1 JOIN b b2 ON b1.c = b2.c),
  r(u, v) AS (SELECT u, v FROM x UNION SELECT r.u, x.v FROM r JOIN x ON r.v = x.u), m AS (SELECT u, min(v) AS least FROM r GROUP BY u)
  SELECT pg.ptm AS ptm_id, dense_rank() OVER (ORDER BY least) AS ptmgroup_id FROM pg JOIN m ON m.u = pg.g""")
def ptm_grouping_merged(s: SparkSession, d: str) -> DataFrame:
    """Groups of ptms that share a group of their states become one."""
    odd = F.col("l_linenumber") % 2
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("ptm_id"), (F.col("l_partkey") * 2 + odd).alias("ptmn_id"), F.lit("P").alias("ptm_type"), F.lit(1).alias("nselptms"), F.col("l_orderkey").alias("peptide_id"), (F.col("l_orderkey") * 2 + odd).alias("pepmodstate_id"), F.lit(0).alias("ptm_offset"))
    return ptm.ptm_groups(rows)[0].select("ptm_id", "ptmgroup_id")


@query("token_offsets_square", """SELECT p_partkey, w AS peptide_seq, 'Phospho' AS ptm_type, 'STY' AS "ptm_AAs", substr(w, 2, 1) AS "ptm_AA_seq", CAST(1 AS BIGINT) AS ptm_offset FROM (SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS w FROM part)""")
def token_offsets_square(s: SparkSession, d: str) -> DataFrame:
    w = F.regexp_replace("p_name", "[^a-z]", "")
    seq = F.concat(F.lit("_"), F.substring(w, 1, 2), F.lit("[Phospho (STY)]"), F.substring(w, 3, 1000), F.lit("_"))
    return ptm.extract_ptms(table(s, d, "part").select("p_partkey", seq.alias("pepmod_seq")), "spectronaut", "p_partkey").drop("is_selptm")


@query("ptm_counts", "SELECT p_partkey, CAST(2 AS BIGINT) AS nptms, CAST(1 AS BIGINT) AS nselptms FROM part")
def ptm_counts(s: SparkSession, d: str) -> DataFrame:
    seq = F.concat(F.lit("_A(Oxidation (M))"), "p_brand", F.lit("(Phospho (STY))_"))
    return ptm.ptm_stats(table(s, d, "part").select("p_partkey", seq.alias("pepmod_seq")), "maxquant", "p_partkey", selected="Phos")


@query("locprobs_checked", "SELECT p_partkey, p_size AS rawfile_ix, 'Phospho' AS ptm_type, 'S' AS \"ptm_AA_seq\", CAST(1 AS BIGINT) AS ptm_offset, p_size / 100.0 AS ptm_locprob FROM part")
def locprobs_checked(s: SparkSession, d: str) -> DataFrame:
    """Probabilities of residues that the modified sequence does not have modified are left out."""
    prob = F.concat(F.lit("_AS[Phospho (STY): "), "p_size", F.lit("%]KT[Phospho (STY): 1%]R_"))
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").alias("rawfile_ix"), prob.alias("ptm_locprob_seq"), F.lit("_AS[Phospho (STY)]KTR_").alias("pepmod_seq"))
    return ptm.extract_ptm_locprobs(rows, "spectronaut", "p_partkey", ptmtype_col=None, modseq_col="pepmod_seq", report_col="p_partkey").withColumn("ptm_locprob", F.round("ptm_locprob", 6))


# --- proteins


@query("group_lists", """SELECT l_suppkey AS group_id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS majors, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS peps FROM lineitem GROUP BY l_suppkey""")
def group_lists(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem")
    kind = lambda k, c: lines.select(F.col("l_suppkey").alias("group_id"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("item")).distinct()
    return proteins.group_records(kind("major", "l_partkey").union(kind("pep", "l_orderkey"))).select("group_id", F.array_join("major_prots", ",").alias("majors"), F.array_join("peps", ",").alias("peps"))


@query("rollup_by_rank", """SELECT l_suppkey AS protgroup_id, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY p_size, CAST(l_partkey AS VARCHAR)) AS parts FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def rollup_by_rank(s: SparkSession, d: str) -> DataFrame:
    groups = table(s, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").cast("string").alias("item")).distinct().withColumn("kind", F.lit("major"))
    ranks = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_size").alias("rank"))
    return proteins.group_table(groups, ranks).select("protgroup_id", F.col("majority_protein_acs").alias("parts"))


@query("scored_intersection", """SELECT a.p_partkey, nullif(array_to_string(list_transform(list_sort(list_transform(list_intersect(list_distinct(string_split(a.p_name, ' ')), string_split(b.p_name, ' ')), lambda t: {'s': CASE t WHEN 'blue' THEN 1 WHEN 'red' THEN 2 ELSE 9 END, 't': t})), lambda x: x.t), ';'), '') AS common,
  a.p_size > 40 OR b.p_size > 40 AS flag FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def scored_intersection(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", ";").alias("a"), (F.col("p_size") > 40).alias("x"))
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"), F.col("x").alias("y")), "p_partkey")
    order = F.create_map(F.lit("blue"), F.lit(1.0), F.lit("red"), F.lit(2.0))
    return pairs.select("p_partkey", proteins.intersect_lists(F.col("a"), F.col("b"), order=order).alias("common"), proteins.any_flag(F.col("x"), F.col("y"), F.lit(None).cast("boolean")).alias("flag"))


_OVERLAP = """SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS best_pg_rank, CAST(1 AS BIGINT) AS worst_pg_rank, CAST(2 AS BIGINT) AS best_ac_rank, CAST(2 AS BIGINT) AS worst_ac_rank, CAST(1 AS BIGINT) AS pgrank_a, CAST(2 AS BIGINT) AS acrank_a, CAST(0 AS BIGINT) AS pgrank_b, CAST(2 AS BIGINT) AS acrank_b, 'A' AS majority, 'A' AS proteins
  UNION ALL SELECT 1, 1, 1, 2, 2, 1, 2, 1, 2, NULL, 'A;B' UNION ALL SELECT 2, 0, 0, 2, 2, 0, 2, 0, 2, 'A', 'A;B'"""


@query("group_matching_overlap", f"""WITH o AS ({_OVERLAP}) SELECT s_suppkey AS rowix_a, s_suppkey AS rowix_b, best_pg_rank, worst_pg_rank, best_ac_rank, worst_ac_rank, pgrank_a, acrank_a, pgrank_b, acrank_b,
  CASE WHEN k = 0 THEN s_suppkey || majority ELSE array_to_string(list_transform(string_split(majority, ';'), lambda x: s_suppkey || x), ';') END AS majority_protein_acs, array_to_string(list_transform(string_split(proteins, ';'), lambda x: s_suppkey || x), ';') AS protein_acs
  FROM supplier JOIN o ON k = s_suppkey % 3""")
def group_matching_overlap(s: SparkSession, d: str) -> DataFrame:
    """Accessions with penalties (A: 2, B: 7) in lists that overlap.

    0: a leads with B and lists A as a member, b leads with A.  A's member reference (1, 2) comes first, and B's leading one (0, 7) is better
    in one rank alone, so a keeps (1, 2).  1: both lead with B and list A, and for the same reason no reference of rank 0 is left.  2: both lead with A.
    """
    kind = F.col("s_suppkey") % 3
    key = F.col("s_suppkey").cast("string")
    named = lambda *acs: F.concat_ws(";", *[F.concat(key, F.lit(a)) for a in acs])
    ac = lambda lead: F.when(kind == 0, named(lead)).when(kind == 1, named("B")).otherwise(named("A"))
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("row_ix"), ac("B").alias("lead_a"), ac("A").alias("lead_b"), named("A", "B").alias("both"), named("A").alias("one"), kind.alias("kind"))
    a = sup.select("row_ix", F.col("lead_a").alias("majority_protein_acs"), F.when(F.col("kind") == 1, named_swap("both")).otherwise(F.col("both")).alias("protein_acs"))
    b = sup.select("row_ix", F.col("lead_b").alias("majority_protein_acs"), F.when(F.col("kind") == 0, F.col("one")).otherwise(F.col("both")).alias("protein_acs"))
    penalties = table(s, d, "supplier").select(F.explode(F.array(F.struct(F.concat(key, F.lit("A")).alias("ac"), F.lit(2).alias("penalty")), F.struct(F.concat(key, F.lit("B")).alias("ac"), F.lit(7).alias("penalty")))).alias("x")).select("x.*")
    return proteins.match_protgroups({"a": a, "b": b}, penalties)


def named_swap(c: str) -> Column:
    """A two-element list the other way round."""
    return F.array_join(F.reverse(F.split(c, ";")), ";")


@query("site_union", "SELECT p_partkey AS k, p_brand AS a, NULL AS b FROM part WHERE p_size > 40 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def site_union(s: SparkSession, d: str) -> DataFrame:
    return proteins.union_sites(table(s, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("a")), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b")))


@query("reference_rows", "SELECT p_partkey, p_size = min(p_size) OVER (PARTITION BY p_brand) AS is_least FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_size)")
def reference_rows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"))
    return rows.select("p_partkey", proteins.reference_flag("p_brand", "p_size").alias("is_least"))


# --- set filters

_SCORES = "SELECT l_suppkey AS sup, l_partkey AS part, round(-sum(l_discount) * 40, 6) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("part")).agg(F.round(-F.sum("l_discount") * 40, 6).alias("score"), F.count("*").alias("n"))


@query("automask", f"""WITH x AS (SELECT * FROM ({_SCORES}) WHERE n >= 1 AND part <= 1500), b AS (SELECT sup, min(score) AS best FROM x GROUP BY sup),
  k AS (SELECT min(k) AS k FROM (SELECT unnest(range(0, 400)) AS k) WHERE (SELECT count(*) FROM b WHERE best <= -2 - k * 0.5) <= 30)
  SELECT x.sup, part, score, n FROM x JOIN b ON x.sup = b.sup, k WHERE best <= -2 - k * 0.5 AND score <= -1 - k * 0.5""")
def automask(s: SparkSession, d: str) -> DataFrame:
    """p of 0.01 for a set's best and 0.1 for its rows, as logarithms, to start with."""
    rows = _scores(s, d)
    return sets.automask(rows, "sup", "score", "n", "part", max_sets=30, min_nmasked=1, max_setsize=1500)[0]


@query("autoweight", f"""WITH x AS ({_SCORES}), b AS (SELECT sup, min(score) AS best FROM x GROUP BY sup), k AS (SELECT min(k) AS k FROM (SELECT unnest(range(0, 400)) AS k) WHERE (SELECT count(*) FROM b WHERE best <= 0.01 - k * 0.5) <= 30)
  SELECT x.sup, part, score, n FROM x JOIN b ON x.sup = b.sup, k WHERE best <= 0.01 - k * 0.5 AND score <= 1.01 - k * 0.5""")
def autoweight(s: SparkSession, d: str) -> DataFrame:
    return sets.autoweight(_scores(s, d), "sup", "score", max_sets=30)[0]


@query("counts_by_collection", """WITH m AS (SELECT DISTINCT l_returnflag AS coll, l_suppkey AS set_id, l_partkey AS obj FROM lineitem), o AS (SELECT p_partkey AS obj FROM part WHERE p_size > 10), r AS (SELECT p_partkey AS obj FROM part WHERE p_size > 30),
  a AS (SELECT count(*) AS n FROM (SELECT obj FROM o UNION SELECT obj FROM r)), h AS (SELECT count(*) AS n FROM r)
  SELECT coll, set_id, count(*) FILTER (o.obj IS NOT NULL AND r.obj IS NOT NULL) AS n_both, count(r.obj) AS n_ref, count(o.obj) AS n_obs, count(*) AS n_set, any_value(a.n) AS n_all, any_value(h.n) AS n_hit
  FROM m LEFT JOIN o ON m.obj = o.obj LEFT JOIN r ON m.obj = r.obj CROSS JOIN a CROSS JOIN h GROUP BY coll, set_id""")
def counts_by_collection(s: SparkSession, d: str) -> DataFrame:
    members = table(s, d, "lineitem").select(F.col("l_returnflag").alias("coll"), F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("obj"))
    part = table(s, d, "part").select(F.col("p_partkey").alias("obj"), "p_size")
    return sets.set_counts(members, part.where("p_size > 10").select("obj"), part.where("p_size > 30").select("obj"), "set_id", "obj", "coll")


@query("members_by_source", "SELECT DISTINCT l_suppkey AS term_id, l_partkey AS obj_id, 'N' || s_nationkey AS coll_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def members_by_source(s: SparkSession, d: str) -> DataFrame:
    members = table(s, d, "lineitem").select(F.col("l_suppkey").alias("term_id"), F.col("l_partkey").alias("obj_id")).distinct()
    info = table(s, d, "supplier").select(F.col("s_suppkey").alias("term_id"), F.concat(F.lit("N"), "s_nationkey").alias("src"))
    return sets.group_by_source(info, members).select("term_id", "obj_id", "coll_id")


@query("filter_multicover_own_limits", f"""WITH x AS ({_SCORES}), t AS (SELECT DISTINCT part FROM x WHERE score <= -8 AND n >= 1), u AS (SELECT DISTINCT sup FROM x WHERE score <= -4 AND n >= 1 AND part IN (SELECT part FROM t))
  SELECT sup, part, score, n FROM x WHERE part IN (SELECT part FROM t) AND sup IN (SELECT sup FROM u) AND score <= -2""")
def filter_multicover_own_limits(s: SparkSession, d: str) -> DataFrame:
    return sets.filter_multicover(_scores(s, d), ["part"], ["sup"], "score", "n", 1e-8, 1e-4, 1e-2, 1, 1, 0)


# --- networks

_RESTARTS = "SELECT k / 20.0 AS r FROM range(1, 20) t(k)"


@query("walk_weights", f"""SELECT round(r, 2) AS restart_prob, part AS vertices, round(CASE part WHEN 'neighbors' THEN r * (1 - r) ELSE r * (1 - r) * (1 - r) END, 6) AS trans_probs FROM ({_RESTARTS}), (VALUES ('neighbors'), ('exterior')) p(part) WHERE (SELECT count(*) FROM supplier) > 0""")
def walk_weights(s: SparkSession, d: str) -> DataFrame:
    """Every supplier leads to its nation, every nation to its region, where walks end."""
    sup = table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("source"), (F.col("s_nationkey") * 3 + 1).cast("long").alias("target"))
    nation = table(s, d, "nation").select((F.col("n_nationkey") * 3 + 1).cast("long").alias("source"), (F.col("n_regionkey") * 3 + 2).cast("long").alias("target"))
    got = network.walk_weight_stats(sup.unionByName(nation), sup.select(F.col("source").alias("start")))
    return got.select(F.round("restart_prob", 2).alias("restart_prob"), "vertices", F.round("trans_probs", 6).alias("trans_probs"))


@query("stationary_walk", """SELECT s_suppkey * 3 AS start, v.vertex, CAST(round(v.p, 6) AS DOUBLE) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey, LATERAL (SELECT unnest([s_suppkey * 3, n_nationkey * 3 + 1, n_regionkey * 3 + 2]) AS vertex, unnest([0.5, 0.25, 0.125]) AS p) v""")
def stationary_walk(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("source"), (F.col("s_nationkey") * 3 + 1).cast("long").alias("target"))
    nation = table(s, d, "nation").select((F.col("n_nationkey") * 3 + 1).cast("long").alias("source"), (F.col("n_regionkey") * 3 + 2).cast("long").alias("target"))
    return network.restart_walk(sup.unionByName(nation), sup.select(F.col("source").alias("start")), 0.5, 0.05).select("start", "vertex", F.round("p", 6).alias("p"))


def _flow_frames(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    vertices = sup.select(key.cast("long").alias("vertex"), F.col("s_nationkey").alias("component"), (key % 2 == 0).alias("is_source"), (key % 3 == 0).alias("is_sink"), (key % 5 == 0).alias("is_steptrace"))
    edges = sup.select(key.cast("long").alias("source"), (key + 1).cast("long").alias("target"), (F.col("s_acctbal") / 1000).alias("walkweight"), F.lit(0.0).alias("walkweight_rev"), (key % 2 == 0).alias("has_original"), F.lit(False).alias("has_original_rev"))
    return vertices, edges


@query("flow_vertex_types", """SELECT 'v' || s_suppkey AS node, 'g' || s_nationkey AS component_node, CASE WHEN s_suppkey % 6 = 0 THEN 'source/sink' WHEN s_suppkey % 2 = 0 THEN 'source' WHEN s_suppkey % 3 = 0 THEN 'sink' WHEN s_suppkey % 5 = 0 THEN 'step' ELSE 'gene' END AS vertex_type FROM supplier
  UNION ALL SELECT DISTINCT 'g' || s_nationkey, NULL, 'connected_component' FROM supplier""")
def flow_vertex_types(s: SparkSession, d: str) -> DataFrame:
    vertices, edges = _flow_frames(s, d)
    nodes, _ = network.graph_frames(network.flow_vertices(vertices), network.with_attributes(edges.withColumnRenamed("source", "source_node").withColumnRenamed("target", "target_node"), ["source_node", "target_node"], ["has_original"]))
    return nodes.select("node", "component_node", "vertex_type")


@query("layout_weights", """WITH e AS (SELECT s_suppkey AS s, s_suppkey + 1 AS t, greatest(s_acctbal / 1000, 0) AS w, s_suppkey % 2 = 0 AS o FROM supplier), n AS (SELECT v, count(*) AS d, bool_or(o) AS o FROM (SELECT s AS v, o FROM e UNION ALL SELECT t, o FROM e) GROUP BY v), m AS (SELECT avg(w) FILTER (w > 0) AS m FROM e),
  k AS (SELECT e.*, a.d AS ds, b.d AS dt, a.o AS os, b.o AS ot, s % 3 = 0 OR t % 3 = 0 AS sink FROM e JOIN n a ON a.v = s JOIN n b ON b.v = t WHERE t IN (SELECT s_suppkey FROM supplier))
  SELECT s AS source, t AS target, round(pow(least(greatest(w / m, 0.01), 5.0), 0.25) * CASE WHEN sink THEN CASE WHEN o THEN 10.0 ELSE 10.0 / sqrt(least(ds, dt)) END WHEN o THEN 3.0 WHEN os AND ot THEN 0.5 / (least(ds, dt) * least(ds, dt)) ELSE 1.0 / sqrt(least(ds, dt)) END, 6) AS layout_weight FROM k, m""")
def layout_weights(s: SparkSession, d: str) -> DataFrame:
    vertices, edges = _flow_frames(s, d)
    _, out = network.layout_weights(network.flow_vertices(vertices, component_groups=False), edges)
    inside = out.join(vertices.select(F.col("vertex").alias("target")), "target", "left_semi")
    return inside.select("source", "target", F.round("layout_weight", 6).alias("layout_weight"))


@query("flow_paths", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '→' || p_brand || '→?→|→' || p_type || '→' END AS flowpaths FROM part")
def flow_paths(s: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    paths = F.when(F.col("p_size") % 2 == 0, F.array(F.array("p_brand", F.lit(None).cast("string")), none, F.array("p_type"))).otherwise(F.array(none))
    return table(s, d, "part").select("p_partkey", network.flow_path(paths).alias("flowpaths"))


# --- noise model and calibration


# a model for each part
_MODELS = {"zScale": "0.5 + p_size / 100.0", "zShift": "5.0 + p_size / 8.0", "zDetectionFactor": "1.25", "zDetectionIntercept": "2.0 - p_size / 4.0", "detectionMax": "0.75", "sigmaScaleHi": "1.0 + p_size / 16.0", "sigmaScaleLo": "0.5", "sigmaOffset": "-0.25", "sigmaBend": "p_size / 16.0 - 1", "sigmaSmooth": "0.5", "outlierProb": "0.0625"}


def _models(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", *[F.expr(x).cast("double").alias(c) for c, x in _MODELS.items()])


_MODEL_SQL = f"SELECT p_partkey, {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for c, x in _MODELS.items())} FROM part"


@query("model_text", f"""SELECT p_partkey, printf('Z=(Log₂(signal)%+.3f)*%.3f', -"zShift", "zScale") || chr(10) || printf('P(detect|Z)=%.4f Logit⁻¹(%.4f Z%+.4f)', "detectionMax", "zDetectionFactor", "zDetectionIntercept") || chr(10)
  || printf('std(signal)=2^(½(%.4f%+.4f)(Z%+.4f)+½(%.4f%+.4f)√((Z%+.4f)²%+.4f)%+.4f) P(outlier)=0.0625', "sigmaScaleHi", "sigmaScaleLo", -"sigmaBend", "sigmaScaleHi", -"sigmaScaleLo", -"sigmaBend", "sigmaSmooth", "sigmaOffset") || chr(10) AS shown FROM ({_MODEL_SQL})""")
def model_text(s: SparkSession, d: str) -> DataFrame:
    return _models(s, d).select("p_partkey", noise.model_texts(2.0).alias("shown"))


_D = "((log2(value) - 5.0) * 0.7 - 0.2)"
_LOGSTD = f"(0.5 * 1.5 * {_D} + 0.5 * 0.7000000000000001 * sqrt({_D} * {_D} + 0.5) + -0.3)"


@query("rebased_model", f"SELECT event_id, round((log2(value) - 5.0) * 0.7, 6) AS z FROM events WHERE value > 0")
def rebased_model(s: SparkSession, d: str) -> DataFrame:
    """Z scores do not depend on the base of logarithms."""
    return table(s, d, "events").where("value > 0").select("event_id", F.round(MODEL.with_base(10.0).zscore(F.col("value")), 6).alias("z"))


_ERR = f"((value - 100) * pow(2.0, -{_LOGSTD}))"
_MIX = f"ln((1 - 1e-4) * exp(-{_ERR} * {_ERR} / 2) / sqrt(2 * pi()) + 1e-4 / (pi() * (1 + {_ERR} * {_ERR})))"


@query("error_loglik", f"SELECT event_id, round({_MIX} - ({_LOGSTD} - 5.0) * ln(2.0), 5) AS llh, abs({_ERR}) <= {MODEL.distr.threshold!r} AS is_inlier FROM events WHERE value > 0")
def error_loglik(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    z = MODEL.zscore(v)
    return table(s, d, "events").where("value > 0").select("event_id", F.round(MODEL.signal_loglik(v, F.lit(100.0)), 5).alias("llh"), MODEL.is_inlier(v - 100.0, z).alias("is_inlier"))


@query("likelihood_terms", f"""SELECT event_id, round(CASE WHEN seen THEN {_MIX} - ({_LOGSTD} - 5.0) * ln(2.0) ELSE 0 END + greatest(ln(1e-3), -ln(1 + exp(CASE WHEN seen THEN -1 ELSE 1 END * t))), 5) AS llh
  FROM (SELECT event_id, value, event_type <> 'view' AS seen, log2(value) * {MODEL.detection_factor!r} + {MODEL.detection_intercept!r} AS t FROM events WHERE value > 0 AND value <> 100)""")
def likelihood_terms(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    error = F.when(F.col("event_type") != "view", v - 100.0)
    llh, _ = calib.loglik_terms(MODEL, error, MODEL.zscore(v), F.log2(v))
    return table(s, d, "events").where("value > 0 and value <> 100").select("event_id", F.round(llh, 5).alias("llh"))


@query("model_prior", f"""WITH m AS ({_MODEL_SQL}), g AS (SELECT pow(2.0, k) AS x FROM range(1, 11) t(k)), d AS (SELECT *, (ln(x) / ln(2.0) - "zShift") * "zScale" - "sigmaBend" AS d FROM m, g),
  r AS (SELECT *, pow(2.0, 0.5 * ("sigmaScaleHi" + "sigmaScaleLo") * d + 0.5 * ("sigmaScaleHi" - "sigmaScaleLo") * sqrt(d * d + "sigmaSmooth") + "sigmaOffset") / x AS r FROM d)
  SELECT p_partkey, round(ln(abs(sum(-0.5 * (r / 0.1) * (r / 0.1) - ln(0.1) - 0.5 * ln(2 * pi())) * 3 - 2 * ln(pi()) - ln(1 + pow(any_value("zDetectionIntercept"), 2)) - ln(1 + pow(any_value("zDetectionFactor"), 2))
  + 9.0 * ln(0.75) + 0.1 * ln(0.25) - (lgamma(10.0) + lgamma(1.1) - lgamma(11.1)))), 6) AS log_abs_prior FROM r GROUP BY p_partkey""")
def model_prior(s: SparkSession, d: str) -> DataFrame:
    """Q1 of each model over a grid of ten powers of two, weighed as 30 rows; its size by logarithm, as it has up to twenty digits."""
    return _models(s, d).select("p_partkey", F.round(F.ln(F.abs(calib.log_priors([2.0**k for k in range(1, 11)], 30, 2.0))), 6).alias("log_abs_prior"))


@query("score_front", "WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS b FROM part) SELECT p_partkey, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b))")
def score_front(s: SparkSession, d: str) -> DataFrame:
    return stats.skyline(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b")), "a", "b")


@query("factory_model", "SELECT event_id, round((log2(value) - 3.0) * 2.0, 6) AS z, round(pow(2.0, (0.5 * 3.0 * d + 0.5 * 1.0 * sqrt(d * d + 1.0) + 0.25)), 4) AS std FROM (SELECT event_id, value, (log2(value) - 3.0) * 2.0 - 0.5 AS d FROM events WHERE value BETWEEN 1 AND 50)")
def factory_model(s: SparkSession, d: str) -> DataFrame:
    model = calib.ModelFactory(2.0, 3.0).model([1.0, 0.0, 0.9, 2.0, 1.0, 0.25, 0.5, 1.0])
    v = F.col("value")
    return table(s, d, "events").where("value between 1 and 50").select("event_id", F.round(model.zscore(v), 6).alias("z"), F.round(model.signal_std(v), 4).alias("std"))


@query("protgroup_intensities", "SELECT p_partkey, r AS msrun, CASE r WHEN 'a' THEN p_size ELSE p_size * 2 END AS intensity FROM part, (VALUES ('a'), ('b')) t(r)")
def protgroup_intensities(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").alias("Intensity.a"), (F.col("p_size") * 2).alias("Intensity.b"))
    return calib.protgroup_data(rows, ["p_partkey"])


_CHANNELS = "SELECT DISTINCT event_type AS msrun, CAST(length(event_type) % 2 AS VARCHAR) AS experiment FROM events"


def _channels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("msrun"), (F.length("event_type") % 2).cast("string").alias("experiment")).distinct()


@query("used_intensities", f"""WITH c AS ({_CHANNELS}), k AS (SELECT experiment FROM c GROUP BY 1 HAVING count(DISTINCT msrun) > 1)
  SELECT event_id, c.experiment AS expchannel, value AS intensity, round(log2(value), 6) AS logintensity FROM events JOIN c ON event_type = c.msrun WHERE c.experiment IN (SELECT experiment FROM k) AND value > 0 AND user_id % 2 = 0""")
def used_intensities(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    objects = e.select("event_id", (F.col("user_id") % 2 == 0).alias("use_for_calib"))
    channels = calib.used_channels(_channels(s, d))
    got = calib.used_intensities(e.select("event_id", F.col("event_type").alias("msrun"), "value"), objects, channels, "event_id", intensity="value")
    return got.select("event_id", "expchannel", "intensity", F.round("logintensity", 6).alias("logintensity"))


_SEEN = "SELECT user_id AS obj, event_type AS msrun, 'e' AS expchannel, max(value) AS intensity, log2(max(value)) AS l FROM events GROUP BY 1, 2"


def _seen(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("obj"), F.col("event_type").alias("msrun")).agg(F.max("value").alias("intensity"))
    return rows.where("intensity > 0").withColumn("expchannel", F.lit("e")).withColumn("logintensity", F.log2("intensity"))


@query("run_shifts", f"""WITH u AS (SELECT * FROM ({_SEEN}) WHERE intensity > 0), q AS (SELECT *, row_number() OVER (PARTITION BY msrun ORDER BY l, obj) / CAST(count(*) OVER (PARTITION BY msrun) AS DOUBLE) AS q FROM u),
  p AS (SELECT a.msrun, a.l - f.l AS shift, 0.5 * sqrt(a.q + f.q) AS w FROM q a JOIN q f ON a.obj = f.obj AND f.msrun = (SELECT min(msrun) FROM u))
  SELECT msrun, round(sqrt(greatest(sum(shift * shift * w) / sum(w) - pow(sum(shift * w) / sum(w), 2), 0)), 5) AS logshift_sd, count(*) AS npairs FROM p GROUP BY msrun""")
def run_shifts(s: SparkSession, d: str) -> DataFrame:
    got = calib.run_shifts(_seen(s, d), "obj")
    return got.select("msrun", F.round("logshift_sd", 5).alias("logshift_sd"), "npairs")


@query("run_shift_medians", f"""WITH u AS (SELECT * FROM ({_SEEN}) WHERE intensity > 0), q AS (SELECT *, row_number() OVER (PARTITION BY msrun ORDER BY l, obj) / CAST(count(*) OVER (PARTITION BY msrun) AS DOUBLE) AS q FROM u),
  p AS (SELECT a.msrun, a.l - f.l AS shift, 0.5 * sqrt(a.q + f.q) AS w FROM q a JOIN q f ON a.obj = f.obj AND f.msrun = (SELECT min(msrun) FROM u)),
  c AS (SELECT msrun, shift, sum(w) OVER o - w / 2 AS mid, sum(w) OVER (PARTITION BY msrun) / 2 AS half FROM p WINDOW o AS (PARTITION BY msrun ORDER BY shift ROWS UNBOUNDED PRECEDING)),
  n AS (SELECT *, lag(mid) OVER (PARTITION BY msrun ORDER BY mid) AS mid0, lag(shift) OVER (PARTITION BY msrun ORDER BY mid) AS shift0 FROM c),
  h AS (SELECT msrun, arg_min(CASE WHEN mid0 IS NULL THEN shift ELSE shift0 + (half - mid0) / (mid - mid0) * (shift - shift0) END, mid) AS m FROM n WHERE mid >= half GROUP BY msrun)
  SELECT msrun, round(m, 4) AS logshift, round(pow(2.0, m), 4) AS mult FROM h""")
def run_shift_medians(s: SparkSession, d: str) -> DataFrame:
    return calib.run_shifts(_seen(s, d), "obj").select("msrun", F.round("logshift", 4).alias("logshift"), F.round("mult", 4).alias("mult"))


@query("z_parameters", "SELECT round(avg(ln(value)), 6) AS shift, round(1 / stddev_samp(ln(value)), 6) AS scale FROM events WHERE value > 0")
def z_parameters(s: SparkSession, d: str) -> DataFrame:
    shift, scale = calib.z_parameters(table(s, d, "events").where("value > 0").select(F.ln("value").alias("logintensity")))
    return s.createDataFrame([(round(shift, 6), round(scale, 6))], "shift double, scale double")


@query("quantile_ranks", "SELECT event_id, row_number() OVER w AS rank, round(row_number() OVER w / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS qtl FROM (SELECT event_id, event_type, value + event_id / 1e9 AS v FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY v)")
def quantile_ranks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", "event_type", (F.col("value") + F.col("event_id") / 1e9).alias("v"))
    return stats.ranked(rows, ["event_type"], ["v"], "rank", "qtl").select("event_id", "rank", F.round("qtl", 6).alias("qtl"))


@query("weighted_spread", "SELECT l_suppkey, round(sqrt(greatest(sum(l_discount * l_discount * l_quantity) / sum(l_quantity) - pow(sum(l_discount * l_quantity) / sum(l_quantity), 2), 0)), 6) AS sd FROM lineitem GROUP BY l_suppkey")
def weighted_spread(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(stats.weighted_sd(F.col("l_discount"), F.col("l_quantity")), 6).alias("sd"))


# --- matrices


# suppliers by line number and flag, with gaps: cells that are not there are 0, a member without a length is at 100 from all
@query("axis_distances", """WITH c AS (SELECT l_suppkey AS a, l_returnflag || l_linenumber AS o, CASE WHEN l_suppkey % 50 = 7 THEN 0 ELSE round(avg(l_quantity), 6) END AS x FROM lineitem WHERE l_quantity > 49 GROUP BY 1, 2),
  n AS (SELECT a, sqrt(sum(x * x)) AS n FROM c GROUP BY a), p AS (SELECT c.a, e.a AS b, sum(c.x * e.x) AS d FROM c JOIN c e ON c.o = e.o AND c.a < e.a GROUP BY 1, 2)
  SELECT m.a, k.a AS b, CASE WHEN m.n * k.n > 0 THEN round(greatest(1 - coalesce(d, 0) / (m.n * k.n), 0), 6) ELSE 100 END AS distance FROM n m JOIN n k ON m.a < k.a LEFT JOIN p ON p.a = m.a AND p.b = k.a""")
def axis_distances(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "lineitem").where("l_quantity > 49").groupBy("l_suppkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("o")).agg(F.round(F.avg("l_quantity"), 6).alias("x"))
    zeros = cells.withColumn("score", F.when(F.col("l_suppkey") % 50 == 7, 0.0).otherwise(F.col("x")))
    return matrices.cosine_distances(zeros, "l_suppkey", "o", digits=6)


# of three members the nearest two merge first and stand last, as a cluster comes after a single leaf; columns are sorted
@query("heatmap_order", """WITH c AS (SELECT l_returnflag AS r, l_suppkey AS c, -sum(l_discount) * 9 AS s, count(*) AS n FROM lineitem WHERE l_quantity > 45 AND l_tax > 0.05 GROUP BY 1, 2), z AS (SELECT r, c, sqrt(-s) AS x FROM c WHERE s < 0),
  l AS (SELECT r, sqrt(sum(x * x)) AS l FROM z GROUP BY r), d AS (SELECT p.r AS a, q.r AS b, 1 - (SELECT sum(u.x * v.x) FROM z u JOIN z v ON u.c = v.c WHERE u.r = p.r AND v.r = q.r) / (p.l * q.l) AS d FROM l p JOIN l q ON p.r < q.r),
  m AS (SELECT a, b FROM d ORDER BY d, a, b LIMIT 1), o AS (SELECT r, CASE WHEN r = a THEN 2 WHEN r = b THEN 3 ELSE 1 END AS row_place FROM l, m), k AS (SELECT DISTINCT c FROM c)
  SELECT o.r AS l_returnflag, k.c AS l_suppkey, CAST(row_place AS BIGINT) AS row_place, dense_rank() OVER (ORDER BY k.c) AS column_place, round(s, 4) AS score FROM o CROSS JOIN k LEFT JOIN c ON c.r = o.r AND c.c = k.c""")
def heatmap_order(s: SparkSession, d: str) -> DataFrame:
    covers = table(s, d, "lineitem").where("l_quantity > 45 and l_tax > 0.05").groupBy("l_returnflag", "l_suppkey").agg((-F.sum("l_discount") * 9).alias("set_original_weight"), F.count("*").alias("nmasked"))
    drawn = matrices.ordered_heatmap(matrices.heatmap_cells(covers, ["l_returnflag"], ["l_suppkey"]), "l_returnflag", "l_suppkey", column_order=None)
    return drawn.select("l_returnflag", "l_suppkey", "row_place", "column_place", F.round(F.nanvl("score", F.lit(None).cast("double")), 4).alias("score"))


@query("axis_members", "SELECT l_suppkey AS member, row_number() OVER (ORDER BY l_suppkey) AS place FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def axis_members(s: SparkSession, d: str) -> DataFrame:
    return matrices.axis_places(table(s, d, "lineitem"), "l_suppkey", "l_partkey", order=None)


@query("permutation_traces", """WITH r AS (SELECT l_suppkey AS threshold, avg(l_quantity) AS m, avg(l_quantity) * 3 AS hi, 0.0 AS lo FROM lineitem WHERE l_suppkey BETWEEN 5 AND 60 GROUP BY 1), b AS (SELECT 0.5 * min(m) AS l, 2 * max(m) AS h FROM r)
  SELECT threshold, round(m, 6) AS m, round(least(greatest(hi, l), h), 6) AS m_hi, round(least(greatest(lo, l), h), 6) AS m_lo FROM r, b""")
def permutation_traces(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("threshold")).agg(F.avg("l_quantity").alias("m")).withColumn("m_hi", F.col("m") * 3).withColumn("m_lo", F.lit(0.0))
    deltas = rows.select(F.lit("s").alias("stat"), F.lit("v").alias("value_type"), "threshold", F.col("m").alias("value"), F.col("m").alias("permuted_value"), F.lit(0.0).alias("delta"))
    real, _, _ = matrices.permutation_traces(rows, rows, deltas, "threshold", "m", (5, 60))
    return real.select("threshold", *[F.round(c, 6).alias(c) for c in ("m", "m_hi", "m_lo")])


@query("permutation_deltas", "SELECT l_returnflag AS stat, l_linestatus AS value_type, max(abs(l_tax - l_discount)) AS most FROM lineitem GROUP BY 1, 2")
def permutation_deltas(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("stat"), F.col("l_linestatus").alias("value_type"), F.col("l_suppkey").alias("threshold"), F.col("l_tax").alias("value"), F.col("l_discount").alias("permuted_value"), (F.col("l_tax") - F.col("l_discount")).alias("delta"))
    _, _, best = matrices.permutation_traces(rows.withColumn("m", F.lit(0.0)), rows.withColumn("m", F.lit(0.0)), rows, "threshold", "m")
    return best.select("stat", "value_type", F.abs("delta").alias("most"))


# --- evidence parts whole


@query("evidence_proteins", "SELECT l_partkey AS peptide_id, CAST(l_suppkey AS VARCHAR) AS protein_ac, bool_or(l_linenumber % 2 = 0) AS is_lead, bool_or(l_linenumber % 3 = 0) AS is_razor FROM lineitem GROUP BY 1, 2")
def evidence_proteins(s: SparkSession, d: str) -> DataFrame:
    sup, line = F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    rows = table(s, d, "lineitem").select(
        F.col("l_partkey").alias("peptide_id"), F.lit("x").alias("peptide_seq"), F.lit("y").alias("pepmod_seq"), line.alias("charge"), sup.alias("peptide_protein_acs"), F.when(line % 2 == 0, sup).alias("lead_protein_acs"),
        F.when(line % 3 == 0, sup).alias("lead_razor_protein_ac"), F.lit("r").alias("msrun"), F.col("l_quantity").alias("intensity"),
    )
    return wide.decompose_evidence(wide.finish_evidence(rows)).peptide2protein



# --- what is drawn at random, by what must hold


# draws by the digest of seed and event: the bins' grids and running sums, and the first place of these that is not below the draw
def _uniform(seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || event_id), 1, 13)) AS BIGINT) / 4503599627370496.0"


_WIDTH = 8 / (MODEL.zScale * 3.0)
DRAWS = f"""e AS (SELECT event_id, event_type, value, ln(value) / {math.log(2.0)!r} AS l FROM events WHERE value > 0), q AS (SELECT quantile_cont(l, {[k / 10 for k in range(1, 11)]}) AS q FROM e),
  c AS (SELECT event_id, event_type, value, l, q, least(len(list_filter(q, lambda x: x <= l)), 9) AS b FROM e, q), g AS (SELECT b, k, q[b + 1] AS mid, q[b + 1] + {_WIDTH!r} * (k / 200.0 - 0.5) * 2 AS x FROM q, range(10) AS t(b), range(201) AS u(k)),
  w AS (SELECT b, k, mid, x, exp(-pow((x - mid) * {MODEL.zScale * 3.0!r}, 2) / 2 - (greatest(y, 0) + ln(1 + exp(-abs(y))))) AS w FROM (SELECT *, x * {MODEL.detection_factor * 10.0!r} + {MODEL.detection_intercept!r} AS y FROM g)),
  s AS (SELECT b, any_value(mid) AS mid, list(x ORDER BY k) AS xs, list(s ORDER BY k) AS upto FROM (SELECT *, sum(w) OVER (PARTITION BY b ORDER BY k) AS s FROM w) GROUP BY b),
  d AS (SELECT event_id, event_type, value, c.b, mid, xs[1 + len(list_filter(upto, lambda y: y < {_uniform(1)} * upto[201]))] AS missed FROM c JOIN s ON c.b = s.b)"""


@query("simulated_bounds", f"WITH {DRAWS} SELECT event_id, round(mid, 6) AS bin_end, round(missed, 6) AS missed_log, abs(missed - mid) <= {_WIDTH + 1e-6} AS is_near FROM d")
def simulated_bounds(s: SparkSession, d: str) -> DataFrame:
    """Missing values by event, within the grid around the end of their bin."""
    e = table(s, d, "events").where("value > 0").select("event_id", "value")
    logs = e.withColumn("l", MODEL.log(F.col("value")))
    cuts = F.array(*map(F.lit, stats.exact_quantiles(logs, "l", [k / 10 for k in range(1, 11)])))
    rows = MODEL.simulate_missing(logs, "value", keys=["event_id"]).withColumn("at", F.get(cuts, F.least(F.size(F.filter(cuts, lambda q: q <= F.col("l"))), F.lit(9))))
    return rows.select("event_id", F.round("at", 6).alias("bin_end"), F.round("missed_log", 6).alias("missed_log"), (F.abs(F.col("missed_log") - F.col("at")) <= _WIDTH + 1e-6).alias("is_near"))


@query("missed_quantiles", f"WITH {DRAWS} SELECT CAST(b AS INTEGER) AS bin, count(*) AS n, round(quantile_cont(missed, 0.1), 6) AS q10, round(quantile_cont(missed, 0.5), 6) AS q50, round(quantile_cont(missed, 0.9), 6) AS q90 FROM d GROUP BY b")
def missed_quantiles(s: SparkSession, d: str) -> DataFrame:
    """What is drawn in each bin of signals, by its quantiles."""
    e = table(s, d, "events").where("value > 0").select("event_id", "value")
    logs = e.withColumn("l", MODEL.log(F.col("value")))
    cuts = F.array(*map(F.lit, stats.exact_quantiles(logs, "l", [k / 10 for k in range(1, 11)])))
    rows = MODEL.simulate_missing(logs, "value", keys=["event_id"]).withColumn("bin", F.least(F.size(F.filter(cuts, lambda q: q <= F.col("l"))), F.lit(9)))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), *[F.round(F.percentile("missed_log", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


# SQL has no evolution: what is found is held against the same search over arrays in tests, the likelihoods below against SQL
@query("calibration_search")
def calibration_search(s: SparkSession, d: str) -> DataFrame:
    """The search ends no worse than it began, inside of the factory's box."""
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("pepmodstate_id"), F.col("event_type").alias("msrun")).agg(F.max("value").alias("intensity")).withColumn("ident_type", F.lit("MSMS"))
    objects = rows.select("pepmodstate_id").distinct().withColumns({"is_contaminant": F.lit(False), "is_reverse": F.lit(False)})
    channels = rows.select("msrun").distinct().withColumn("experiment", F.lit("e"))
    data = calib.calibration_data_of("pepmodstate", {"observations": rows, "pepmodstates": objects}, channels, most=500)
    factory = calib.ModelFactory(data.zScale, data.zShift, data.base)
    best: list[float] = []
    front: list = []
    model, fitness = calib.calibrate(data, factory, rounds=6, population=10, progress=lambda _, f: best.append(f), front=front)
    inside = all(lo <= getattr(model, k) <= hi for k, (lo, hi) in factory.bounds.items())
    ends = abs(max(calib.bayesian_score(p, l) for p, l, _ in front) - fitness) < 1e-6 and len(calib.pareto_front([c[:2] for c in front])) == len(front)
    return s.createDataFrame([(fitness >= best[0] and ends, inside)], "is_better boolean, is_in_box boolean")


def _candidates() -> list[noise.NoiseModel]:
    """The first generation of a search."""
    factory = calib.ModelFactory(0.7, 5.0, 2.0)
    return [factory.model([round(float(x), 3) for x in p]) for p in np.random.default_rng(5).uniform(*np.array([(0.1, 3), (-2, 2), (0.6, 0.99), (0.2, 2), (0.2, 2), (-1, 3), (-2, 2), (0.1, 2)]).T, (6, 8))]


def _llh_sql(k: int, m: noise.NoiseModel) -> str:
    """The sum of terms over all events, and how likely so many outliers are."""
    d = f"((l - {m.zShift!r}) * {m.zScale!r} - {m.sigmaBend!r})"
    logstd = f"({0.5 * (m.sigmaScaleHi + m.sigmaScaleLo)!r} * {d} + {0.5 * (m.sigmaScaleHi - m.sigmaScaleLo)!r} * sqrt({d} * {d} + {m.sigmaSmooth!r}) + {m.sigmaOffset!r})"
    t, p = f"(l * {m.detection_factor!r} + {m.detection_intercept!r})", m.outlierProb
    terms = f"SELECT err, greatest(ln(1e-3), -(greatest(s, 0) + ln(1 + exp(-abs(s))))) AS seen, err * pow(2.0, -{logstd}) AS dev, {logstd} AS ls FROM (SELECT l, err, CASE WHEN err IS NULL THEN {t} ELSE -{t} END AS s FROM e)"
    pdf = f"ln({1 - p!r} * exp(-dev * dev / 2) / sqrt(2 * pi()) + {p!r} / (pi() * (1 + dev * dev))) - (ls - {m.zShift!r}) * ln(2.0)"
    counts = f"SELECT sum(seen) + coalesce(sum({pdf}) FILTER (err <> 0), 0) AS total, count(*) FILTER (err <> 0) AS n, count(*) FILTER (err <> 0 AND abs(dev) <= {m.distr.threshold!r}) AS i FROM ({terms})"
    return f"SELECT {k} AS candidate, round(total + (n - i) * ln({p!r}) + i * ln({1 - p!r}) - (lgamma(n - i + 1) + lgamma(i + 1) - lgamma(n + 2)), 3) AS llh FROM ({counts})"


@query("population_likelihoods", "WITH e AS (SELECT ln(value) / ln(2.0) AS l, CASE WHEN event_type <> 'view' THEN value - 100 END AS err FROM events WHERE value > 0) " + " UNION ALL ".join(_llh_sql(k, m) for k, m in enumerate(_candidates())))
def population_likelihoods(s: SparkSession, d: str) -> DataFrame:
    """One pass for all candidates."""
    v = F.col("value")
    rows = table(s, d, "events").where("value > 0").select(F.when(F.col("event_type") != "view", v - 100.0).alias("error"), MODEL.zscore(v).alias("z"), MODEL.log(v).alias("log"))
    found = calib.population_llh(rows, _candidates())
    return s.createDataFrame([(k, round(x, 3)) for k, x in enumerate(found)], "candidate int, llh double")


# noise of detected values by the model's deviation there, missing ones from the draws
@query("simulated_intensity", f"""WITH {DRAWS} SELECT event_id, round(CASE WHEN event_type <> 'view' THEN value + sqrt(-2 * ln(1 - {_uniform(2)})) * cos(2 * pi() * {_uniform(3)}) * pow(2.0, {LOGSTD}) ELSE pow(2.0, missed) END, 4) AS simulated FROM d""")
def simulated_intensity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("value > 0").select("event_id", "value", F.when(F.col("event_type") != "view", F.col("value")).alias("seen"))
    return MODEL.simulate(e, "seen", "value", keys=["event_id"]).select("event_id", F.round("simulated", 4).alias("simulated"))


# twenty different residues, of which one to three are missing in a supplier's variant: the only best alignment has one gap
_BASE = "ACDEFGHIKLMNPQRSTVWY"


@query("aligned_gaps", f"""WITH v AS (SELECT s_suppkey AS k, 4 + s_suppkey % 8 AS p, 1 + s_suppkey % 3 AS n, 1 + s_nationkey % 20 AS spot FROM supplier)
  SELECT 'B' || k AS protein_ac, 'V' || k AS agn_seqid, CAST(spot AS INTEGER) AS ptm_pos, CAST(CASE WHEN spot < p THEN spot WHEN spot >= p + n THEN spot - n END AS INTEGER) AS agn_pos,
  CASE WHEN spot < p OR spot >= p + n THEN '=' ELSE '-' END AS agn_match, CAST(spot AS INTEGER) AS agn_column, CAST(20 AS BIGINT) AS agn_len, round((20 - n) / 20.0, 6) + 0.0 AS agn_match_ratio,
  (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT unnest([5, 9, 7, 6, 7, 6, 8, 5, 6, 5, 7, 7, 8, 7, 6, 5, 6, 5, 11, 8]) AS s, unnest(range(1, 21)) AS i) WHERE i < p OR i >= p + n) - 10 - n AS agn_score FROM v""")
def aligned_gaps(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "supplier").select("s_suppkey", (4 + F.col("s_suppkey") % 8).cast("int").alias("p"), (1 + F.col("s_suppkey") % 3).cast("int").alias("n"), (1 + F.col("s_nationkey") % 20).cast("int").alias("spot"))
    base = v.select(F.concat(F.lit("B"), "s_suppkey").alias("protein_ac"), F.col("s_suppkey").alias("protgroup_id"), F.lit(_BASE).alias("seq"))
    less = F.concat(F.expr(f"substring('{_BASE}', 1, p - 1)"), F.expr(f"substring('{_BASE}', p + n, 20)"))
    variants = v.select(F.concat(F.lit("V"), "s_suppkey").alias("protein_ac"), F.col("s_suppkey").alias("protgroup_id"), less.alias("seq"))
    objs = v.select(F.concat(F.lit("B"), "s_suppkey").alias("protein_ac"), F.col("s_suppkey").alias("ptm_id"), F.col("spot").alias("ptm_pos"))
    got = ptm.map_positions(objs, base, variants, "protgroup_id")
    return got.select("protein_ac", "agn_seqid", "ptm_pos", "agn_pos", "agn_match", "agn_column", "agn_len", F.round("agn_match_ratio", 6).alias("agn_match_ratio"), "agn_score")


# the recurrence of best scores, a row of the matrix at a time, over lists
_MATRIX = [[blosum90()(a, b) for b in "ARNDCQEGHILKMFPSTWYVBZX*"] for a in "ARNDCQEGHILKMFPSTWYVBZX*"]


@query("aligned_scores", f"""WITH RECURSIVE x AS (SELECT {_MATRIX} AS m), p AS (SELECT a.n_name AS a, b.n_name AS b, a.n_name AS s, b.n_name AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name),
  r(a, b, s, t, i, best, down) AS (SELECT a, b, s, t, 0, list_transform(range(length(t) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -10 - j END), list_transform(range(length(t) + 1), lambda j: -100000) FROM p
    UNION ALL SELECT a, b, s, t, i + 1, list_transform(range(length(t) + 1), lambda j: greatest(base[j + 1], coalesce(list_max(list_transform(range(j), lambda k: base[k + 1] - 10 - (j - k))), -100000))), down
    FROM (SELECT a, b, s, t, i, down, list_transform(range(length(t) + 1), lambda j: greatest(down[j + 1], CASE WHEN j = 0 THEN -100000 ELSE best[j] + coalesce(m[nullif(instr('ARNDCQEGHILKMFPSTWYVBZX*', substr(s, i + 1, 1)), 0)][nullif(instr('ARNDCQEGHILKMFPSTWYVBZX*', substr(t, j, 1)), 0)], -6) END)) AS base
      FROM (SELECT a, b, s, t, i, best, list_transform(range(length(t) + 1), lambda j: greatest(best[j + 1] - 11, down[j + 1] - 1)) AS down FROM r WHERE i < length(s)), x))
  SELECT a AS protein_ac, b AS agn_seqid, CAST(best[length(t) + 1] AS BIGINT) AS agn_score FROM r WHERE i = length(s)""")
def aligned_scores(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_name").alias("protein_ac"), F.col("n_regionkey").alias("protgroup_id"), F.upper("n_name").alias("seq"))
    objs = n.select(F.col("protein_ac").alias("ptm_id"), "protein_ac", F.lit(2).alias("ptm_pos"))
    return ptm.map_positions(objs, n, n, "protgroup_id", self_matches=False).select("protein_ac", "agn_seqid", "agn_score")
