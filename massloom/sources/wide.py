"""Wide instrument reports."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import fill_flags, flag, literal_split, null_tokens
from ..operators.ids import update_pepmodstates
from .catalogues import DIA, DIA_NA, EVIDENCE, EVIDENCE_TYPES, PROTGROUPS, PROTGROUPS_NA
from .columns import ColumnGroup, add_run_metadata

def read_wide_table(spark: SparkSession, path: str, groups: Sequence[ColumnGroup], data: Sequence[str] = (), na: Sequence[str] = ("",), limit: int | None = None, sep: str = "\t") -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(required and requested column groups, their renames by group).

    All values are strings until a group's fixer or the caller casts them; only the selected columns are parsed from the file.
    """
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="FAILFAST", nullValue=None, emptyValue="", quote='"')
    known = {g.name for g in groups}
    if unknown := [d for d in data if d not in known]:
        warnings.warn(f"unknown column groups: {unknown}", stacklevel=2)
    clean = raw.select(*[null_tokens(F.col(f"`{c}`"), na).alias(c) for c in raw.columns])
    cols, renames, done = [], {}, set()
    for g in groups:
        if not (g.required or g.name in data):
            continue
        own, names = g.columns(clean, done)
        flags = {new: old for old, new in names.items() if new in g.flags}
        own = [F.coalesce(flag(F.col(f"`{old}`")), F.lit(False)).alias(new) if new in flags else c for c, (old, new) in zip(own, names.items(), strict=True)]
        if own:
            renames[g.name] = names
            cols += own
            done |= set(names.values())
    if not cols:
        raise ValueError(f"no column group matches {path}")
    out = fill_flags(clean.select(*cols))
    return (out if limit is None else out.limit(limit)), renames


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Explicit casts of those columns that are there."""
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items() if c in df.columns})


def read_protgroups(spark: SparkSession, folder: str, data: Sequence[str] = ("intensity",), file_name: str = "proteinGroups.txt", limit: int | None = None) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """S2."""
    df, renames = read_wide_table(spark, f"{folder}/{file_name}", PROTGROUPS, data, PROTGROUPS_NA, limit)
    return cast_columns(df, {"protgroup_id": "long", "ident_score": "double", "q_value": "double", "n_proteins": "int", "seqlen": "int", "mol_weight_kDa": "double", "n_peptides": "int", "n_peptides_unique": "int", "n_peptides_unique_razor": "int", "seqcov": "double", "n_ms2": "int"}), renames


def read_evidence(spark: SparkSession, folder: str, msruns: DataFrame | None = None, data: Sequence[str] = ("peptide", "pepmodstate"), file_name: str = "evidence.txt", limit: int | None = None) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """S3: the report with run metadata (skipped runs dropped), msrun, the code of its identification type and ids of states."""
    df, renames = read_wide_table(spark, f"{folder}/{file_name}", EVIDENCE, data, PROTGROUPS_NA, limit)
    df = cast_columns(df, {"evidence_id": "long", "peptide_id": "long", "intensity": "double", "charge": "int", "psm_score": "double", "psm_pvalue": "double", "rt": "double", "mz": "double"})
    if msruns is not None:
        df = add_run_metadata(df, msruns, list(renames.get("mschannel", {}).values()))
        if "is_skipped" in df.columns:
            df = df.where(~F.coalesce("is_skipped", F.lit(False))).drop("is_skipped")
    return finish_evidence(df), renames


def finish_evidence(df: DataFrame) -> DataFrame:
    """msrun is the experiment, with _F<fraction> where there is one; raw file where there is no experiment."""
    if "msrun" not in df.columns:
        run = F.col("msexperiment") if "msexperiment" in df.columns else F.col("rawfile")
        if "msfraction" in df.columns:
            run = F.concat(run, F.coalesce(F.concat(F.lit("_F"), F.col("msfraction").cast("string")), F.lit("")))
        df = df.withColumn("msrun", run)
    if "ident_type" in df.columns:
        levels = F.create_map(*[x for k, t in enumerate(EVIDENCE_TYPES, 1) for x in (F.lit(t), F.lit(k))])
        df = df.withColumn("ident_type_code", F.element_at(levels, F.col("ident_type")))
    return update_pepmodstates(df) if {"peptide_id", "pepmod_seq", "charge"} <= set(df.columns) else df


def read_dia_report(spark: SparkSession, path: str, data: Sequence[str] = ("quantity", "pepmodstate", "peptide"), limit: int | None = None) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """S4."""
    return read_wide_table(spark, path, DIA, data, DIA_NA, limit)


@dataclass(frozen=True)
class Evidence:
    """The parts of an evidence report."""

    peptides: DataFrame
    pepmods: DataFrame
    pepmodstates: DataFrame
    peptide2protgroup: DataFrame | None
    peptide2protein: DataFrame
    observations: DataFrame


def decompose_evidence(df: DataFrame) -> Evidence:
    """An evidence frame with its ids, in parts; protein links say whether the protein leads or is the razor protein."""
    have = lambda *cols: [c for c in cols if c in df.columns]
    links = df.select("peptide_id", *have("lead_razor_protein_ac"), F.col("peptide_protein_acs").alias("acs"), F.lit(False).alias("is_lead")).distinct()
    if "lead_protein_acs" in df.columns:
        links = links.unionByName(df.select("peptide_id", *have("lead_razor_protein_ac"), F.col("lead_protein_acs").alias("acs"), F.lit(True).alias("is_lead")).distinct())
    each = links.where("acs is not null").select("*", F.explode(literal_split(F.col("acs"), ";")).alias("protein_ac"))
    razor = F.coalesce(F.col("protein_ac") == F.col("lead_razor_protein_ac"), F.lit(False)) if "lead_razor_protein_ac" in df.columns else F.lit(False)
    proteins = each.groupBy("peptide_id", "protein_ac").agg(F.bool_or("is_lead").alias("is_lead"), F.bool_or(razor).alias("is_razor"))
    groups = df.select("peptide_id", F.explode(literal_split(F.col("protgroup_ids"), ";")).alias("protgroup_id")).distinct() if "protgroup_ids" in df.columns else None
    flags = have("is_reverse", "is_contaminant")
    return Evidence(
        df.groupBy("peptide_id", "peptide_seq").agg(*[F.bool_or(c).alias(c) for c in flags]) if flags else df.select("peptide_id", "peptide_seq").distinct(),
        df.select("pepmod_id", "peptide_id", "pepmod_seq").distinct(), df.select("pepmodstate_id", "pepmod_id", "charge", *have("msfraction")).distinct(),
        groups, proteins, df.select("pepmodstate_id", *have("evidence_id", "msrun", "rawfile", "ident_type", "intensity", "rt", "psm_pvalue")),
    )
