"""Text formats: FASTA, GMT, GTF, site annotations, motif alignments, networks, set collections."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import extract_or_null, literal_split, minus_to_null
from ..functions.strings import fix_annotation_source
from ..operators.network import directed_edges
from .catalogues import SITE_COLUMNS, SITE_FILES, SITE_OVERRIDES
from .rdata import read_rdata

# Header grammars, with numbered groups.
UNIPROT = r"^(sp|tr)\|([^|]+)\|(\S+)\s(.+)\sOS=(.+?(?=\s(?:GN|PE|SV)\=|$))?(?:\sGN=([^=]+))?(?:\sPE=(\S+))?(?:\sSV=(\S+))?$"
ENSEMBL_AC = r"(ENS\w+\d+)"
ENSEMBL_ANNOTATIONS = r"\spep:(.+)\s(chromosome|supercontig|scaffold):(.+)\sgene:(.+)\stranscript:(.+)\sgene_biotype:(.+)\stranscript_biotype:(.+)"
ENSEMBL_SAAVS = r"(?:\s+(\S+))?"
CONTAMINANT_DB = "SWISS-PROT|TREMBL|REFSEQ|ENSEMBL|H-INV"
CONTAMINANT_1 = rf"(CON__\w+(?:-\d+)?)\s?({CONTAMINANT_DB}):(\w+(?:-\d+)?)(?:\||\s|;)(?:\((.+)\)\s)?(.+)"
CONTAMINANT_2 = rf"CON__({CONTAMINANT_DB}):(\w+(?:-\d+)?)(?:\||\s|;)(?:\((.+)\)\s)?(.+)"
SITE_FASTA = r"GN:([^|]+)\|([^|]+)\|([^|]+)\|([^|]*)$"
MOTIF = r"^(.+)\|(.+)\/(\d+)-(\d+)\: (.+)\|(.+)$"
MOTIF_RANGE = r"^(.+)\/(\d+)\.(\d+)$"


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(fasta_header, seq): one row per record; a record is one line of the reader, so files split at records."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("v")).where(F.trim("v") != "")
    header = F.regexp_replace(F.substring_index("v", "\n", 1), r"\r$", "")
    body = F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise(F.lit(""))
    return text.select(header.alias("fasta_header"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_lines(spark: SparkSession, path: str, order: str) -> DataFrame:
    """(value, order): lines with their place in the input; splits of a file may come in any order."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("ix"))
    return spark.read.text(path).select("value", at.alias(order))


def _fields(header: Column, pattern: str, names: Sequence[str]) -> dict[str, Column]:
    return {n: extract_or_null(header, pattern, k) for k, n in enumerate(names, 1)}


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """A header of another form keeps its row with nulls."""
    f = _fields(F.col("fasta_header"), UNIPROT, ("src_db", "protein_ac", "protein_code", "protein_name", "organism", "genename", "protein_existence", "seq_version"))
    f |= {k: f[k].cast("int") for k in ("protein_existence", "seq_version")}
    return read_fasta(spark, path).select(*[c.alias(n) for n, c in f.items()], "seq", "fasta_header")


def read_ensembl(spark: SparkSession, path: str, has_annotations: bool = True, has_saavs: bool = False) -> DataFrame:
    """Accession alone, with annotations, or with amino acid variants."""
    if has_annotations and has_saavs:
        raise ValueError("annotations and variants exclude each other")
    names = ["protein_ac"]
    pattern = ENSEMBL_AC
    if has_annotations:
        pattern, names = ENSEMBL_AC + r"(?:\.\d+)?" + ENSEMBL_ANNOTATIONS, [*names, "status", "loctype", "location", "gene_ac", "transcript_ac", "gene_biotype", "transcript_biotypes"]
    elif has_saavs:
        pattern, names = ENSEMBL_AC + ENSEMBL_SAAVS, [*names, "SAAVs"]
    return read_fasta(spark, path).select(*[c.alias(n) for n, c in _fields(F.col("fasta_header"), pattern, names).items()], "seq", "fasta_header")


def read_contaminants(spark: SparkSession, path: str) -> DataFrame:
    """The first grammar, else the second, else nulls."""
    h = F.col("fasta_header")
    one = _fields(h, CONTAMINANT_1, ("protein_ac", "src_db", "_", "organism", "protein_name"))
    two = _fields(h, CONTAMINANT_2, ("src_db", "protein_ac", "organism", "protein_name"))
    first = h.rlike(CONTAMINANT_1)
    return read_fasta(spark, path).select(*[F.when(first, one[n]).otherwise(two[n]).alias(n) for n in ("protein_ac", "src_db", "organism", "protein_name")], "seq", "fasta_header")


def read_site_fasta(spark: SparkSession, path: str) -> DataFrame:
    """S8: "-" is null."""
    f = _fields(F.col("fasta_header"), SITE_FASTA, ("genename", "protein_name", "organism", "protein_ac"))
    return read_fasta(spark, path).select(*[minus_to_null(c).alias(n) for n, c in f.items()], "seq", "fasta_header")


def read_gmt(spark: SparkSession, path: str, id_col: str = "term_id", src_col: str = "src", name_col: str = "name", descr_col: str = "descr", fix_source: bool = True, obj_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """(info of sets, members (set, obj)).  An id that occurs in several lines has the members of the last; info keeps all."""
    lines = read_lines(spark, path, "_line").where(F.trim("value") != "")
    parts = literal_split(F.rtrim("value"), "\t")
    names = literal_split(F.get(parts, F.lit(0)), "%")
    three = F.when(F.size(names) == 3, names).otherwise(F.raise_error(F.concat(F.lit("not name%source%id: "), F.get(parts, F.lit(0)))).cast("array<string>"))
    src = F.get(three, F.lit(1))
    src = fix_annotation_source(src) if fix_source else src
    term = F.get(three, F.lit(2))
    term = F.when((src == "Reactome") & term.rlike(r"^\d+$"), F.concat(F.lit("R-HSA-"), term)).otherwise(term)
    rows = lines.select("_line", term.alias(id_col), src.alias(src_col), F.get(three, F.lit(0)).alias(name_col), F.get(parts, F.lit(1)).alias(descr_col), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("_objs"))
    last = rows.groupBy(id_col).agg(F.max_by("_objs", "_line").alias("_objs"))
    members = last.select(id_col, F.explode(F.array_distinct(F.col("_objs").cast(f"array<{obj_type}>"))).alias("obj_id")).where("obj_id is not null")
    return rows.select(id_col, src_col, name_col, descr_col), members


GTF_SCHEMA = "seqname string, src_db string, feature string, start long, end long, score string, strand string, frame string, attribute string"


def read_gtf(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Comments start with "#!"; all rows, or at most ``max_rows`` of them."""
    fields = literal_split(F.col("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#!") & (F.col("value") != ""))
    names = [f.split() for f in GTF_SCHEMA.split(", ")]
    out = rows.select(*[F.get(fields, F.lit(k)).cast(t).alias(n) for k, (n, t) in enumerate(names)])
    return out if max_rows is None else out.limit(max_rows)


def attribute_map(attrs: Column) -> Column:
    """E5: map of tag to value; of a repeated tag the last counts, chunks of another form are left out."""
    tags, values = _attributes(attrs)
    names = F.array_distinct(tags)
    return F.map_from_arrays(names, F.transform(names, lambda t: F.element_at(values, F.array_position(tags, t).cast("int"))))


def _attributes(attrs: Column) -> tuple[Column, Column]:
    """Tags and values, the last first, by one pass each over the text."""
    chunk = F.lit(r'(?:^|;)\s*([^;\r\n]+)\s"([^;\r\n]+)"\s*(?=;|$)')
    return tuple(F.reverse(F.regexp_extract_all(attrs, chunk, F.lit(k))) for k in (1, 2))


def parse_attributes(df: DataFrame, col: str = "attribute", tags: Sequence[str] | None = None) -> DataFrame:
    """E5: one column per tag; without ``tags`` a pass finds them."""
    found, values = _attributes(F.col(col))
    if tags is None:
        tags = [r[0] for r in df.select(F.explode(found)).distinct().orderBy("col").collect()]
    rows = df.withColumn("_tags", found).withColumn("_values", values)
    last = lambda t: F.array_position("_tags", t).cast("int")
    return rows.select(*df.columns, *[F.when(last(t) > 0, F.try_element_at("_values", F.greatest(last(t), F.lit(1)))).alias(t) for t in tags])


def read_site_annotations(spark: SparkSession, folder: str, gz: bool = False, header_line: int = 4) -> dict[str, DataFrame]:
    """Site datasets by name; the header is at a fixed line, gzip is transparent."""
    out = {}
    for name, file in SITE_FILES.items():
        path = f"{folder}/{file}{'.gz' if gz else ''}"
        head = [r[0] for r in spark.read.text(path).limit(header_line).collect()]
        if len(head) < header_line:
            raise ValueError(f"{path} has no line {header_line}")
        own = SITE_COLUMNS | SITE_OVERRIDES.get(name, {})
        header = head[-1].rstrip("\r").split("\t")
        fields = literal_split(F.regexp_replace("value", "\r$", ""), "\t")
        # what stands before the header is told by its text: those lines have fewer fields or are the header's own
        skip = head
        rows = read_lines(spark, path, "row_ix").where((F.trim("value") != "") & ~F.col("value").isin(skip))
        cols = {own.get(h, h): F.nullif(F.get(fields, F.lit(k)), F.lit("")) for k, h in enumerate(header)}
        df = rows.select("row_ix", *[c.alias(n) for n, c in cols.items()])
        if "MOD_RSD" in df.columns:
            pattern, c = r"(\w)(\d+)-(\w+)", "MOD_RSD"
            df = df.withColumns({"ptm_AA": extract_or_null(F.col(c), pattern, 1), "ptm_pos": extract_or_null(F.col(c), pattern, 2).cast("long"), "ptm_code": extract_or_null(F.col(c), pattern, 3)})
        elif "SUB_MOD_RSD" in df.columns:
            pattern, c = r"(\w)(\d+)", "SUB_MOD_RSD"
            df = df.withColumns({"ptm_AA": extract_or_null(F.col(c), pattern, 1), "ptm_pos": extract_or_null(F.col(c), pattern, 2).cast("long")})
        out[name] = df
    return out


def read_motif_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """All *.msa files; a header of another form is an error when computed."""
    h = F.col("fasta_header")
    fine = F.when(h.rlike(MOTIF), h).otherwise(F.raise_error(F.concat(F.lit("unexpected motif header: "), h)).cast("string"))
    rows = read_fasta(spark, f"{folder}/*.msa").withColumn("_h", fine)
    g = lambda k: F.regexp_extract("_h", MOTIF, k)
    ref = g(6)
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    ranged = ref.rlike(MOTIF_RANGE)
    return rows.select(
        g(1).alias("protein_name"), g(2).alias("protein_ac"), span(g(3), g(4)).alias("protein_range"), g(5).alias("motif_name"),
        F.when(ranged, F.regexp_extract(ref, MOTIF_RANGE, 1)).otherwise(ref).alias("motif_id"),
        F.when(ranged, span(F.regexp_extract(ref, MOTIF_RANGE, 2), F.regexp_extract(ref, MOTIF_RANGE, 3))).alias("motif_range"), "seq",
    )


def read_set_collections(spark: SparkSession, paths: dict[str, str], organism: str = "Hs") -> DataFrame:
    """(coll_id, set_id, obj_id) of Parquet files (set_id, obj_id) by collection name; a missing file is left out with a warning.

    Saved R lists are read by ``read_set_workspaces``.
    """
    parts = []
    for name, path in paths.items():
        try:
            part = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  Spark tells a missing path by its message alone
            if "PATH_NOT_FOUND" not in str(e):
                raise
            warnings.warn(f"collection {name} is not at {path}, skipped", stacklevel=2)
            continue
        parts.append(part.select(F.lit(f"{organism}_SigDB_{name}").alias("coll_id"), "set_id", F.col("obj_id").cast("long").alias("obj_id")))
    if not parts:
        return spark.createDataFrame([], "coll_id string, set_id string, obj_id long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# Set collections by the name of their file, and organisms.
SET_COLLECTIONS = {"c2": "C2", "c6": "C6", "c7": "C7", "H": "Hallmark"}
SET_ORGANISMS = {"Mm": "mouse", "Hs": "human"}


def read_set_workspaces(spark: SparkSession, folder: str, organism: str = "Hs", version: str = "v5p2") -> DataFrame:
    """(coll_id, set_id, obj_id) of the saved R lists <organism>_<collection>_<version>.rdata; a missing file is left out with a warning.

    A workspace holds one list of sets, some megabytes, which the driver parses.
    """
    rows = []
    for name, title in SET_COLLECTIONS.items():
        path = f"{folder}/{SET_ORGANISMS[organism]}_{name}_{version}.rdata"
        try:
            data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        except Exception as e:  # noqa: BLE001  Spark tells a missing path by its message alone
            if "PATH_NOT_FOUND" not in str(e):
                raise
            warnings.warn(f"collection {name} is not at {path}, skipped", stacklevel=2)
            continue
        sets = read_rdata(data)[f"{organism}.{name}"]
        rows += [(f"{organism}_SigDB_{title}", set_id, [int(x) for x in members]) for set_id, members in sets.items()]
    lists = spark.createDataFrame(rows, "coll_id string, set_id string, objs array<long>")
    return lists.select("coll_id", "set_id", F.explode(F.array_distinct("objs")).alias("obj_id"))


def read_network(spark: SparkSession, interactions: str, directions: str) -> DataFrame:
    """Directed edges of an interaction file and its dictionary of directions."""
    tsv = lambda p: spark.read.csv(p, sep="\t", header=True, inferSchema=False)
    lower = lambda df: df.toDF(*[c.lower() for c in df.columns])
    fi = lower(tsv(interactions))
    return directed_edges(fi.withColumn("score", F.col("score").cast("double")), lower(tsv(directions)))

