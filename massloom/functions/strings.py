"""Scalar functions on identifiers, annotations and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nulls import extract_or_null

ISOFORM = r"^(\w+)-(?:PRO_)?(\d+)$"

# Ordered, case-insensitive rewrites of annotation sources; the first that occurs wins.
ANNOTATION_SOURCES = (
    ("GObp", "GO_BP"),
    ("GOcc", "GO_CC"),
    ("GOmf", "GO_MF"),
    ("Reactome Database ID Release|REACTOME", "Reactome"),
    ("PANTHER PATHWAY", "Panther_Pathway"),
    ("PATHWAY INTERACTION", "NCI_Nature"),
    ("WikiPathways", "WikiPathways"),
)

# How modifications and their localisation probabilities are written, by report format.
PTM_PATTERNS = {
    "maxquant": r"\((\w+)\s\((\w+|Protein [NC]-term)\)\)",
    "spectronaut": r"\[(\w+)\s\((\w+|Protein [NC]-term)\)\]",
}
LOCPROB_PATTERNS = {
    "maxquant": r"\((\d+(?:\.\d+)?)\)",
    "spectronaut": r"\[(\w+)\s\((\w+|Protein [NC]-term)\):\s(\d+(?:\.\d+)?)%\]",
}


def strip_isoform(ac: Column) -> Column:
    """Accession without isoform or chain number."""
    return F.regexp_replace(ac, ISOFORM, "$1")


def isoform_number(ac: Column) -> Column:
    return extract_or_null(ac, ISOFORM, 2).cast("int")


def rank_accession(ac: Column, gene: Column, src_db: Column, existence: Column) -> Column:
    """Penalty, least is best."""
    isoform = F.coalesce(isoform_number(ac) - 1, F.lit(0))
    database = F.when(src_db == "sp", 0).otherwise(3)
    return F.when(gene.isNull(), 10).otherwise(0) + isoform + database + F.coalesce(existence, F.lit(7)) - 1


def first_rewrite(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first pattern that occurs, case ignored; else the value."""
    out = c
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def fix_annotation_source(c: Column) -> Column:
    return first_rewrite(c, ANNOTATION_SOURCES)


def collapse_values(value: Column, order: Column, delim: str = "; ") -> Column:
    """E6 as an aggregate: non-null values in the given order, joined; null if there are none."""
    items = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v")))))
    return F.when(F.count(value) > 0, F.array_join(F.transform(items, lambda x: x["v"]), delim))


def flanking_sequence(seq: Column, pos: Column, flank: int = 15) -> Column:
    """Upper-cased window around a 1-based position, padded with "_"."""
    pad = F.lit("_" * flank)
    return F.substring(F.concat(pad, F.upper(seq), pad), pos.cast("int"), F.lit(2 * flank + 1))


def ptm_pattern(fmt: str) -> str:
    """E9."""
    if fmt not in PTM_PATTERNS:
        raise ValueError(f"unknown modification format: {fmt}")
    return PTM_PATTERNS[fmt]


def locprob_pattern(fmt: str) -> str:
    """E10."""
    if fmt not in LOCPROB_PATTERNS:
        raise ValueError(f"unknown modification format: {fmt}")
    return LOCPROB_PATTERNS[fmt]


def parse_locprob(text: Column, fmt: str) -> Column:
    """The first probability of a text, as a share."""
    if fmt == "maxquant":
        return extract_or_null(text, locprob_pattern(fmt), 1).cast("double")
    return extract_or_null(text, locprob_pattern(fmt), 3).cast("double") / 100


def ptm_label(ptm_type: Column, group: Column, aa: Column, pos: Column, extra: Column | None = None) -> Column:
    """type_group[-extra]_AApos."""
    name = F.coalesce(group.cast("string"), F.lit("Unknown"))
    if extra is not None:
        name = F.concat(name, F.coalesce(F.concat(F.lit("-"), extra.cast("string")), F.lit("")))
    return F.concat(ptm_type, F.lit("_"), name, F.lit("_"), aa, pos.cast("string"))


def escape_arrows(c: Column) -> Column:
    """E12."""
    return F.regexp_replace(F.regexp_replace(c, "<", "&lt;"), ">", "&gt;")


def flow_label(vertices: Column, names: Column, weights: Column | None = None) -> Column:
    """Sorted vertices as "label(n) ..."; ``vertices`` and ``names`` are parallel arrays.

    n counts how often the vertex occurs, or sums its weights.
    """
    items = F.arrays_zip(vertices.alias("v"), names.alias("n"), (F.transform(vertices, lambda _: F.lit(1.0)) if weights is None else weights).alias("w"))
    each = F.array_sort(F.array_distinct(F.transform(items, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n")))))

    def label(x: Column) -> Column:
        total = F.aggregate(F.filter(items, lambda y: y["v"] == x["v"]), F.lit(0.0), lambda a, y: a + y["w"])
        return F.concat(F.coalesce(x["n"], x["v"].cast("string")), F.lit("("), (total.cast("long") if weights is None else F.round(total, 6)).cast("string"), F.lit(")"))

    return F.array_join(F.transform(each, label), " ")


CONTRAST = r"^(.+)_vs_([^+-]+)([+-])?$"


def _styled(c: Column, styles: Mapping[str, str]) -> Column:
    out = c
    for key, html in reversed(styles.items()):
        out = F.when(c == key, F.lit(html)).otherwise(out)
    return out


def stylize(c: Column, styles: Mapping[str, str]) -> Column:
    """HTML by id; an unknown id is left as it is."""
    return _styled(c, styles)


def stylize_contrast(c: Column, styles: Mapping[str, str], joiner: str = " vs ") -> Column:
    """Both sides of lhs_vs_rhs[+-] decorated; other values are left."""
    lhs, rhs, sign = (F.regexp_extract(c, CONTRAST, k) for k in (1, 2, 3))
    return F.when(c.rlike(CONTRAST), F.concat(_styled(lhs, styles), F.lit(joiner), _styled(rhs, styles), sign)).otherwise(c)


def replace_chain(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Replacements one after another."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def plain_label(c: Column) -> Column:
    """Without HTML tags."""
    return F.regexp_replace(c, r"</?[^>]+>", "")


def label_lines(c: Column) -> Column:
    """Split at line breaks of either kind."""
    return F.split(c, "<br>\\n?|\\n", -1)


def axis_labels(df: DataFrame, id_col: str, name_cols: Sequence[str], label_col: str = "label", tooltip_cols: Sequence[str] = ()) -> DataFrame:
    """Label from the first name that is not null; labels that several ids share get the id appended.

    The tooltip joins what is known of ``tooltip_cols``.
    """
    name = F.coalesce(*[F.col(c) for c in name_cols], F.col(id_col).cast("string"))
    named = df.withColumn(label_col, name)
    shared = named.groupBy(label_col).agg(F.countDistinct(id_col).alias("_n")).where("_n > 1")
    named = named.join(shared, label_col, "left").withColumn(label_col, F.when(F.col("_n") > 1, F.concat(label_col, F.lit(" ("), F.col(id_col).cast("string"), F.lit(")"))).otherwise(F.col(label_col))).drop("_n")
    if tooltip_cols:
        named = named.withColumn("tooltip", F.concat_ws("<br>", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in tooltip_cols]))
    return named


def axis_tooltip(**parts: Column) -> Column:
    """Known parts as "name: value" lines."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in parts.items()])


def duplicate_flag(label: str) -> Column:
    return F.count("*").over(Window.partitionBy(label)) > 1
