"""Modified sequences: matching, sites, extraction, alignment, grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import literal_split, not_null
from ..functions.strings import locprob_pattern, ptm_label, ptm_pattern
from ..session import materialize, ship_package
from .align import align, blosum90
from .batches import hot_join, tasks
from .graph import connected_components
from .ids import dense_rank_table
from .sets import SIGNATURE, signatures

TERMINAL = ("Protein N-term", "Protein C-term")


def peptide_matches(peptides: DataFrame, acs_col: str = "protein_acs", poses_col: str = "peptide_poses", keys: Sequence[str] = ("peptide_id",)) -> DataFrame:
    """(keys, protein_ac, peptide_pos): the two ";" lists go in parallel, a position may list several by ",".

    Lists of different length are an error when computed.
    """
    acs, poses = literal_split(F.col(acs_col), ";"), literal_split(F.col(poses_col), ";")
    pairs = F.when(F.size(acs) == F.size(poses), F.arrays_zip(acs.alias("ac"), poses.alias("pos"))).otherwise(F.raise_error(F.lit(f"{acs_col} and {poses_col} differ in length")).cast("array<struct<ac:string,pos:string>>"))
    rows = peptides.where(F.col(acs_col).isNotNull()).select(*keys, F.explode(pairs).alias("x"))
    return rows.select(*keys, F.col("x.ac").alias("protein_ac"), F.explode(literal_split(F.col("x.pos"), ",").cast("array<long>")).alias("peptide_pos"))


def occurrences(seq: Column, part: Column) -> Column:
    """1-based starts of the non-overlapping occurrences, from the left."""
    n = F.length(part)
    starts = F.transform(F.split(seq, F.concat(F.lit(r"\Q"), part, F.lit(r"\E")), -1), lambda s: F.length(s))
    at = F.aggregate(
        F.slice(starts, 1, F.size(starts) - 1), F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("found")),
        lambda acc, k: F.struct((acc["next"] + k + n).cast("int").alias("next"), F.array_append(acc["found"], (acc["next"] + k).cast("int")).alias("found")), lambda acc: acc["found"],
    )
    return F.when(n > 0, at).otherwise(F.array().cast("array<int>"))


def match_peptides(peptides: DataFrame, seqs: DataFrame, acs_col: str = "protein_acs", seq_col: str = "peptide_seq", keys: Sequence[str] = ("peptide_id",)) -> DataFrame:
    """(keys, protein_ac, peptide_pos) by search in the sequences (protein_ac, seq); "_" guards are ignored.

    Accessions without a sequence and peptides that do not occur give no row.
    """
    rows = peptides.select(*keys, F.regexp_replace(seq_col, "_", "").alias("_pep"), F.explode(literal_split(F.col(acs_col), ";")).alias("protein_ac"))
    found = rows.join(seqs.select("protein_ac", "seq"), "protein_ac")
    return found.select(*keys, "protein_ac", F.explode(occurrences(F.col("seq"), F.col("_pep")).cast("array<long>")).alias("peptide_pos"))


def ptm_sites(proteins: DataFrame, ptm_aas: Mapping[str, str] | None = None, ac_col: str = "protein_ac", seq_col: str = "seq") -> DataFrame:
    """Every residue (protein_ac, ptm_pos, ptm_AA), or with ``ptm_aas`` (type to allowed residues) those that a type may take."""
    residues = proteins.select(ac_col, F.posexplode(F.split(seq_col, "")).alias("_p", "ptm_AA")).where("ptm_AA <> ''").select(ac_col, (F.col("_p") + 1).cast("long").alias("ptm_pos"), "ptm_AA")
    if ptm_aas is None:
        return residues
    # each residue knows its types: a lookup, not a join
    types = F.array_compact(F.array(*[F.when(F.instr(F.lit(aas), F.col("ptm_AA")) > 0, F.lit(t)) for t, aas in sorted(ptm_aas.items())]))
    return residues.select(ac_col, F.explode(types).alias("ptm_type"), "ptm_pos", "ptm_AA")


def stripped(modseq: Column, fmt: str) -> Column:
    return F.regexp_replace(F.regexp_replace(modseq, ptm_pattern(fmt), ""), "_", "")


def _tokens(seq: Column, pattern: str) -> Column:
    """Array of (token, before): each match and the length of the text before it without earlier matches."""
    tokens = F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(seq, pattern, -1), lambda s: F.struct(F.length(s).alias("n"), F.right(s, F.lit(1)).alias("last")))
    upto = F.transform(tokens, lambda t, i: F.struct(
        t.alias("token"), F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + g["n"]).alias("before"),
        F.try_element_at(F.filter(F.slice(gaps, 1, i + 1), lambda g: g["n"] > 0), F.lit(-1))["last"].alias("aa"),
    ))
    return upto


def extract_ptms(df: DataFrame, fmt: str = "maxquant", objid_col: str = "pepmod_id", modseq_col: str = "pepmod_seq", selected: str | None = None) -> DataFrame:
    """One row per modification: type, allowed residues, residue before it, 0-based offset in the bare sequence.

    The offset counts from the leading "_": a modification before the first residue has -1.
    """
    pattern = ptm_pattern(fmt)
    rows = df.select(objid_col, stripped(F.col(modseq_col), fmt).alias("peptide_seq"), F.explode(_tokens(F.col(modseq_col), pattern)).alias("t"))
    kind = F.regexp_extract("t.token", pattern, 1)
    return rows.select(
        objid_col, "peptide_seq", kind.alias("ptm_type"), F.regexp_extract("t.token", pattern, 2).alias("ptm_AAs"), F.col("t.aa").alias("ptm_AA_seq"),
        (F.col("t.before") - 2).cast("long").alias("ptm_offset"), (F.lit(True) if selected is None else kind.rlike(selected)).alias("is_selptm"),
    )


def ptm_stats(df: DataFrame, fmt: str = "maxquant", objid_col: str = "pepmod_id", modseq_col: str = "pepmod_seq", selected: str | None = None) -> DataFrame:
    """(object, nptms, nselptms) of every row."""
    kinds = F.regexp_extract_all(F.col(modseq_col), F.lit(ptm_pattern(fmt)), F.lit(1))
    return df.select(objid_col, F.size(kinds).cast("long").alias("nptms"), F.size(kinds if selected is None else F.filter(kinds, lambda t: t.rlike(selected))).cast("long").alias("nselptms"))


def extract_ptm_locprobs(df: DataFrame, fmt: str = "maxquant", objid_col: str = "pepmodstate_id", msrun_cols: Sequence[str] = ("rawfile_ix",), seq_col: str = "ptm_locprob_seq", ptmtype_col: str | None = "ptm_type", modseq_col: str | None = None, report_col: str = "report_ix") -> DataFrame:
    """P5: localisation probabilities by residue of every report row; with ``modseq_col`` only of modifications that it has.

    A residue or type that contradicts the modified sequence is an error when computed; the type may differ at termini.
    """
    pattern = locprob_pattern(fmt)
    typed = ptmtype_col is not None
    keep = list(dict.fromkeys([report_col, objid_col, *msrun_cols]))
    source = df.where(F.col(seq_col).isNotNull())
    lead = F.when(F.col(seq_col).startswith("_"), 1).otherwise(0)
    rows = source.select(*keep, *([F.col(ptmtype_col).alias("_type")] if typed else []), *([F.col(modseq_col).alias("_mod")] if modseq_col else []), lead.alias("_lead"), F.explode(_tokens(F.col(seq_col), pattern)).alias("t"))
    kind = F.col("_type") if typed else F.regexp_extract("t.token", pattern, 1)
    prob = F.regexp_extract("t.token", pattern, 1 if fmt == "maxquant" else 3).cast("double") / (1 if fmt == "maxquant" else 100)
    out = rows.select(*keep, *(["_mod"] if modseq_col else []), kind.alias("ptm_type"), F.col("t.aa").alias("ptm_AA_seq"), (F.col("t.before") - F.col("_lead") - 1).cast("long").alias("ptm_offset"), prob.alias("ptm_locprob"))
    if not modseq_col:
        return out
    mod = ptm_pattern(fmt)
    known = F.transform(_tokens(F.col("_mod"), mod), lambda t: F.struct((t["before"] - 2).cast("long").alias("offset"), t["aa"].alias("aa"), F.regexp_extract(t["token"], mod, 1).alias("type"), F.regexp_extract(t["token"], mod, 2).alias("aas")))
    out = out.withColumn("_m", F.get(F.filter(known, lambda m: m["offset"] == F.col("ptm_offset")), F.lit(0))).where("_m is not null")
    fits = (F.col("_m.aa") == F.col("ptm_AA_seq")) & ((F.col("_m.type") == F.col("ptm_type")) | F.col("_m.aas").isin(*TERMINAL))
    return out.withColumn("ptm_type", F.when(fits, F.col("ptm_type")).otherwise(F.raise_error(F.concat(F.lit("probability contradicts "), F.col("_mod"))).cast("string"))).drop("_mod", "_m")


def _text(df: DataFrame, seqid_col: str, group_col: str, name: str) -> DataFrame:
    """(name, group, _t, seq): sequences with a digest that stands for their text; a sequence without text is an error when computed."""
    seq = not_null(F.col("seq"), "a sequence without text")
    return df.select(F.col(seqid_col).alias(name), group_col, F.sha2(seq, 256).alias("_t"), "seq")


def _placed(places: DataFrame, used: DataFrame, dest: DataFrame, group_col: str, self_matches: bool, score: Callable[[str, str], int] | None, gap_open: int, gap_extend: int) -> DataFrame:
    """(group, _t, _p, _d, agn_pos, agn_column, agn_AA, agn_match, agn_score, agn_len, agn_match_ratio): where the places (group, _t, _p) of texts lie in
    the texts _d of their group.  Proteins of one text in a group are one here, and each pair of different texts is aligned once."""
    spark = places.sparkSession
    ship_package(spark)
    score = score or blosum90()
    texts = materialize(used.select("_t", "seq").union(dest.select("_t", "seq")).distinct(), "texts")
    ends = lambda df, c, lo, hi: df.groupBy(group_col, "_t").agg(F.min(c).alias(lo), F.max(c).alias(hi))
    dests = materialize(ends(dest, "dest", "lo2", "hi2").withColumnRenamed("_t", "_d"), "dest-texts")
    met = hot_join(ends(used, "src", "lo", "hi"), dests, [group_col])
    if not self_matches:  # a protein that is alone with its text is not held against itself
        met = met.where("_t <> _d or lo <> hi or lo2 <> hi2 or lo <> lo2")
    met = materialize(met.select(group_col, "_t", "_d"), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a pair's places are sent before the next is aligned
                other = b["dest_seq"][k].as_py()
                total, to, columns, matches, at = align(b["seq"][k].as_py(), other, score, gap_open, gap_extend)
                lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (to, at)]
                letters = pa.array(["".join(other[j - 1] if j else "-" for j in to.tolist())])
                numbers = [pa.array([total]), *lists, letters, pa.array([columns]), pa.array([matches / columns if columns else 0.0])]
                yield pa.RecordBatch.from_arrays([b["_t"].slice(k, 1), b["_d"].slice(k, 1), *numbers], names=["_t", "_d", "agn_score", "places", "columns", "letters", "agn_len", "agn_match_ratio"])

    pairs = materialize(met.select("_t", "_d").distinct(), "text-pairs")
    whole = pairs.join(texts, "_t").join(texts.select(F.col("_t").alias("_d"), F.col("seq").alias("dest_seq")), "_d").select("_t", "_d", "seq", "dest_seq")
    aligned = whole.repartition(tasks(spark, pairs.count(), 1000), "_t", "_d").mapInArrow(run, "_t string, _d string, agn_score long, places array<int>, columns array<int>, letters string, agn_len long, agn_match_ratio double")
    aligned = materialize(aligned, "alignments")
    inside = F.col("_p").between(1, F.length("seq"))
    known = places.join(texts, "_t").select(group_col, "_t", "_p", inside.alias("inside"), F.when(inside, F.substring("seq", F.col("_p"), F.lit(1))).alias("aa"))
    found = known.join(met, [group_col, "_t"]).join(aligned, ["_t", "_d"])
    found = found.withColumn("agn_pos", F.when(F.col("inside"), F.nullif(F.get("places", F.col("_p") - 1), F.lit(0)))).withColumn("agn_AA", F.when(F.col("agn_pos").isNotNull(), F.substring("letters", F.col("_p"), F.lit(1))))
    op = F.when(~F.col("inside") & (F.col("_p") != NOWHERE), F.lit(None).cast("string")).when(F.col("agn_pos").isNull(), "-").when(F.col("agn_AA") == F.col("aa"), "=").otherwise("X")
    column = F.when(F.col("inside"), F.get("columns", F.col("_p") - 1)).alias("agn_column")
    return materialize(found.select(group_col, "_t", "_p", "_d", "agn_pos", column, "agn_AA", op.alias("agn_match"), "agn_score", "agn_len", "agn_match_ratio"), "placed")


#: Stands for an object's position that is null.
NOWHERE = -(1 << 31)


def map_positions(objs: DataFrame, seqs: DataFrame, dest: DataFrame, group_col: str, seqid_col: str = "protein_ac", objid_cols: Sequence[str] = ("ptm_id",), pos_col: str = "ptm_pos", self_matches: bool = True, score: Callable[[str, str], int] | None = None, gap_open: int = -10, gap_extend: int = -1) -> DataFrame:
    """Where each object's residue lies in the sequences of its group, and in the alignment; unmapped objects stay with nulls.

    Only sequences that objects use are aligned, and each pair of different sequence texts once, with BLOSUM90 by default.  Places are found for
    texts; proteins meet only in the result, which is made by blocks of a group's objects and sequences.
    """
    used = _text(seqs.join(objs.select(seqid_col).distinct(), seqid_col, "left_semi"), seqid_col, group_col, "src")
    own = _text(dest, seqid_col, group_col, "dest")
    rows = objs.select(*objid_cols, seqid_col, F.col(pos_col).cast("int").alias(pos_col)).distinct()
    there = rows.join(used.select(F.col("src").alias(seqid_col), group_col, "_t"), seqid_col).withColumn("_p", F.coalesce(F.col(pos_col), F.lit(NOWHERE)))
    placed = _placed(there.select(group_col, "_t", "_p").distinct(), used, own, group_col, self_matches, score, gap_open, gap_extend)
    right = own.select("dest", group_col, F.col("_t").alias("_d"))
    counts = there.groupBy(group_col).count().join(right.select(group_col, "_d").distinct(), group_col)
    mapped = hot_join(there.join(placed, [group_col, "_t", "_p"]), right, [group_col, "_d"], counts)
    if not self_matches:
        mapped = mapped.where(F.col(seqid_col) != F.col("dest"))
    result = [*objid_cols, seqid_col, pos_col, group_col, "agn_seqid", "agn_pos", "agn_column", "agn_AA", "agn_match", "agn_score", "agn_len", "agn_match_ratio"]
    mapped = mapped.withColumnRenamed("dest", "agn_seqid").select(*result)
    known = used.join(own.groupBy(group_col).agg(F.min("dest").alias("lo"), F.max("dest").alias("hi")), group_col)
    if not self_matches:
        known = known.where("lo <> src or hi <> src")
    alone = rows.join(known.select(F.col("src").alias(seqid_col)).distinct(), seqid_col, "left_anti")
    have = {f.name: f.dataType for f in mapped.schema.fields}
    return mapped.unionByName(alone.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(have[c]).alias(c) for c in result]))


def group_objects(objs: DataFrame, seqs: DataFrame, group_col: str = "protgroup_id", seqid_col: str = "protein_ac", rank_col: str = "seq_rank", type_col: str = "ptm_type", aa_col: str = "ptm_AA", pos_col: str = "ptm_pos", force_refseqs: bool = True, self_matches: bool = True, score: Callable[[str, str], int] | None = None, gap_open: int = -10, gap_extend: int = -1) -> DataFrame:
    """Objects that stand at the same residue across a sequence group, with a group id, the reference and a unique label.

    ``objs``: (type, protein, position, residue); ``seqs``: (protein, group, rank, seq).  Residues of better ranked sequences where
    nothing was observed join as candidates with ``force_refseqs``; observed and reference rows are returned.  Proteins of one text in a group
    stand at the same residues, so links are between residues of texts, and each protein's row has one to its own.
    """
    used = _text(seqs.join(objs.select(seqid_col).distinct(), seqid_col, "left_semi"), seqid_col, group_col, "src")
    ranked = objs.join(seqs.select(seqid_col, group_col, rank_col, F.sha2("seq", 256).alias("_t")), seqid_col)
    node = [type_col, group_col, seqid_col, pos_col]
    dest = _text(seqs.join(ranked.select(group_col).distinct(), group_col, "left_semi"), seqid_col, group_col, "dest")
    seen = ranked.select(*node, aa_col, rank_col, "_t").distinct().withColumn("is_observed", F.lit(True))
    sources = materialize(seen.groupBy(type_col, group_col, "_t", F.col(pos_col).cast("int").alias("_p")).agg(F.min(seqid_col).alias("lo"), F.max(seqid_col).alias("hi")).where("_p is not null"), "sources")
    placed = _placed(sources.select(group_col, "_t", "_p").distinct(), used, dest, group_col, self_matches, score, gap_open, gap_extend)
    links = materialize(sources.join(placed.where("agn_match = '='").select(group_col, "_t", "_p", "_d", "agn_pos", "agn_AA"), [group_col, "_t", "_p"]), "links")
    reached = links.groupBy(type_col, group_col, "_d", "agn_pos", "agn_AA").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    there = reached.join(dest.select("dest", group_col, F.col("_t").alias("_d")), [group_col, "_d"])
    if not self_matches:
        there = there.where("lo <> dest or hi <> dest")
    there = there.select(type_col, group_col, F.col("dest").alias(seqid_col), F.col("agn_pos").cast("long").alias(pos_col), F.col("agn_AA").alias(aa_col), F.col("_d").alias("_t")).distinct()
    rows = seen.withColumn(pos_col, F.col(pos_col).cast("long"))
    if force_refseqs:
        unseen = there.join(seen.select(*node), node, "left_anti").join(seqs.select(seqid_col, group_col, rank_col), [seqid_col, group_col])
        rows = rows.unionByName(unseen.select(*node, aa_col, rank_col, "_t").withColumn("is_observed", F.lit(False)))
    place = lambda at, pos: F.struct(F.col(type_col).cast("string").alias("t"), F.col(group_col).cast("string").alias("g"), F.col(at).alias("s"), F.col(pos).cast("long").alias("p"))
    rows = materialize(rows.withColumn("_node", place(seqid_col, pos_col)).withColumn("_place", place("_t", pos_col)), "objects")
    # numbers of the nodes in their order: the least of a component is its name
    rows = materialize(rows.join(dense_rank_table(rows.select("_node").distinct(), ["_node"], "_id"), "_node").drop("_node"), "objects")
    seen = rows.where("is_observed")
    crossed = None
    if not self_matches:  # a text that is not aligned with itself residue by residue: its proteins' pairs
        odd = links.where("_t = _d and _p <> agn_pos").select(place("_t", "_p").alias("_place"), place("_d", "agn_pos").alias("_to"))
        links = links.where("_t <> _d or _p = agn_pos")
        crossed = odd.join(seen.select("_place", F.col(seqid_col).alias("a"), F.col("_id").alias("src")), "_place").join(rows.select(F.col("_place").alias("_to"), F.col(seqid_col).alias("b"), F.col("_id").alias("dst")), "_to").where("a <> b").select("src", "dst")
    first = lambda df, at, name: df.groupBy(F.col("_place").alias(at)).agg(F.min("_id").alias(name))
    ways = links.select(place("_t", "_p").alias("_from"), place("_d", "agn_pos").alias("_to")).distinct()
    ways = materialize(ways.join(first(seen, "_from", "src"), "_from").join(first(rows, "_to", "dst"), "_to"), "ways")
    edges = ways.select("src", "dst")
    for df, at, name in ((seen, "_from", "src"), (rows, "_to", "dst")):
        edges = edges.union(df.join(ways.select(F.col(at).alias("_place"), name).distinct(), "_place").select("_id", name))
    comp = connected_components(edges if crossed is None else edges.union(crossed))
    named = rows.drop("_place", "_t").join(comp.withColumnRenamed("id", "_id"), "_id", "left").withColumn("_comp", F.coalesce("component", "_id"))
    numbers = dense_rank_table(named.select("_comp").distinct(), ["_comp"], "ptm_id")
    best = F.row_number().over(Window.partitionBy("ptm_id").orderBy(F.col(rank_col).asc_nulls_last(), seqid_col, pos_col))
    out = named.join(numbers, "_comp").withColumn("is_reference", best == 1).drop("_id", "_comp", "component")
    refs = out.where("is_reference")
    plain = ptm_label(F.col(type_col), F.col(group_col), F.col(aa_col), F.col(pos_col))
    # groups that would share a label count up from the reference's rank
    nth = F.row_number().over(Window.partitionBy("_plain").orderBy(F.col(rank_col).asc_nulls_last(), "ptm_id")) - 1
    extra = F.greatest(F.coalesce(F.col(rank_col), F.lit(1)).cast("long"), F.lit(1)) + F.col("_nth")
    labels = refs.withColumn("_plain", plain).withColumn("_nth", nth).select("ptm_id", ptm_label(F.col(type_col), F.col(group_col), F.col(aa_col), F.col(pos_col), F.when(extra > 1, extra)).alias("ptm_label"))
    return out.join(labels, "ptm_id").where("is_observed or is_reference")


def set_groups(df: DataFrame, set_col: str, elem_col: str | Sequence[str], group_cols: Sequence[str] = (), name: str = "setgroup_id") -> DataFrame:
    """(group_cols, setgroup_id, set) of sets with identical elements within the group columns, numbered from 1 by
    (group columns, least set).  A null element is none; with several columns an element is their values, nulls too.

    Sets are told by sums of hashes of their elements, made once: none is gathered or compared as a list.
    """
    one = isinstance(elem_col, str)
    keys = [*group_cols, set_col]
    rows = df.select(*keys, *[F.col(c).alias(f"_e{k}") for k, c in enumerate([elem_col] if one else elem_col)])
    parts = [c for c in rows.columns if c not in keys]
    # a set's rows lie together, in several tasks if there are many, so they are summed where they lie
    rows = rows.repartitionByRange(tasks(df.sparkSession, rows.count(), 1 << 20), *keys, *parts).groupBy(*keys, *parts).agg(F.lit(1))
    sets = materialize(signatures(rows, keys, parts, there=F.col("_e0").isNotNull() if one else None), "sets")
    firsts = sets.groupBy(*group_cols, *SIGNATURE).agg(F.min(set_col).alias("_first"))
    numbers = dense_rank_table(firsts, [*group_cols, "_first"], name).where("_first is not null")
    return sets.join(numbers, [*group_cols, *SIGNATURE]).select(*group_cols, name, set_col)


def ptm_groups(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ptm to ptmgroup, ptmn to ptmngroup, ptmgroup to ptmngroup).

    Groups of ptms share the same offsets of the same peptides, groups of ptmns those of the same peptide states; ptm groups that share
    a ptmn group are one.  Merging to a fixpoint is one search for connected components.
    """
    # written once: columns of one value are columns then, by which rows stay dealt
    links = materialize(links.select("ptm_type", "ptm_id", "nselptms", "ptmn_id", "peptide_id", "pepmodstate_id", "ptm_offset"), "links")
    ptm2group = materialize(set_groups(links, "ptm_id", ["peptide_id", "ptm_offset"], ["ptm_type"], "ptmgroup_id"), "ptmgroups")
    ptmn2group = materialize(set_groups(links, "ptmn_id", ["pepmodstate_id", "ptm_offset"], ["ptm_type", "nselptms"], "ptmngroup_id"), "ptmngroups")
    both = links.select("ptm_id", "ptmn_id").distinct().join(ptmn2group, "ptmn_id").join(ptm2group, ["ptm_type", "ptm_id"]).select("ptm_type", "nselptms", "ptmgroup_id", "ptmngroup_id").distinct()
    both = materialize(both, "sharing")
    # ptm groups are even numbers, ptmn groups odd: one component for both
    comp = connected_components(both.select((F.col("ptmgroup_id") * 2).alias("src"), (F.col("ptmngroup_id") * 2 + 1).alias("dst"))).where("id % 2 = 0")
    least = comp.groupBy("component").agg(F.min("id").alias("least"))
    merged = materialize(comp.join(least, "component").select("id", "least"), "merged")  # every ptm group has a ptmn group
    numbers = dense_rank_table(merged.select("least").distinct(), ["least"], "new_id")
    final = materialize(merged.join(numbers, "least").select((F.col("id") / 2).cast("long").alias("ptmgroup_id"), "new_id"), "merged")
    ptm2group = ptm2group.join(final, "ptmgroup_id").select("ptm_type", F.col("new_id").alias("ptmgroup_id"), "ptm_id")
    both = both.join(final, "ptmgroup_id").select("ptm_type", "nselptms", F.col("new_id").alias("ptmgroup_id"), "ptmngroup_id").distinct()
    return ptm2group, ptmn2group, both
