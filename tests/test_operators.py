"""Frame, set, protein, graph, modification, network and calibration operators on hand-made values."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import align, calib, graph, ids, matrices, network, noise, proteins, ptm, reshape, sets


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


# --- ids and reshaping


def test_index_unique(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "o int, v string")
    assert rows(ids.index_unique(df, "v"), "o", "ix") == [(0, 2), (1, 3), (2, 1), (3, 2)]
    assert rows(ids.index_unique(df, "v", order_col="o"), "o", "ix") == [(0, 1), (1, 2), (2, 3), (3, 1)]
    assert ids.index_unique(df.limit(0), "v").collect() == []


def test_surrogates(spark):
    df = spark.createDataFrame([(0, "q", "_A[x]K_", "_A[x]K_.2"), (1, "p", "_AK_", "_AK_.3")], "o int, protgroup_sn_id string, pepmod_seq string, pepmodstate_seq string")
    assert rows(ids.update_protgroups(df.withColumnRenamed("o", "majority_protein_acs_alt")), "protgroup_sn_id", "protgroup_id", "majority_protein_acs") == [("p", 1, 1), ("q", 2, 0)]
    assert rows(ids.update_peptides(df), "peptide_seq", "peptide_id") == [("_AK_", 1), ("_AK_", 1)]
    assert rows(ids.update_pepmodstates_by_order(df, "o"), "pepmod_id", "pepmodstate_id", "charge") == [(0, 0, 2), (1, 1, 3)]


def test_pivots(spark):
    wide = spark.createDataFrame([(1, 1, 2, 3, 4)], ["id", "x.r1", "x.r2", "y.r1", "y.r2"])
    long = reshape.pivot_longer(wide)
    assert long.columns == ["id", "var", "x", "y"] and rows(long) == [(1, "r1", 1, 3), (1, "r2", 2, 4)]
    back = reshape.unstack(long, "id", "var", ["x", "y"], sep=".")
    assert back.columns == ["id", "x.r1", "y.r1", "x.r2", "y.r2"] and rows(back) == [(1, 1, 3, 2, 4)]
    assert reshape.unstack(long, "id", "var", ["x", "y"], group_by="value").columns == ["id", "x_r1", "x_r2", "y_r1", "y_r2"]
    with pytest.raises(ValueError):
        reshape.unstack(long, "id", "var", ["x"], group_by="z")
    with pytest.raises(ValueError):
        reshape.pivot_longer(wide.drop("y.r2"))
    with pytest.warns(UserWarning):
        assert reshape.pivot_longer(wide.select("id")).columns == ["id"]
    assert rows(reshape.pivot_runs_longer(spark.createDataFrame([(1, 5.0)], ["id", "PG_intensity.[2] a.raw"]), ["id"])) == [(1, 5.0, 2, "a.raw")]
    assert rows(reshape.pivot_ptms_longer(spark.createDataFrame([(1, "s")], ["id", "ptm_ids.A.B"]), ["id"])) == [(1, "A.B", "s")]


def test_tensors(spark):
    df = spark.createDataFrame([(1, "r1", "c1", 5), (2, "r2", "c2", 7), (3, "r2", "c2", 8)], "o int, r string, c string, v int")
    cells = reshape.frame_to_array(df, [["r"], ["c"]], "v", default=0, order_col="o")
    assert rows(cells) == [("r1", "c1", 5), ("r1", "c2", 0), ("r2", "c1", 0), ("r2", "c2", 8)]
    nested = reshape.nested_array(cells, ["r"], ["c"])
    assert rows(nested) == [("r1", [5, 0]), ("r2", [0, 8])]
    assert rows(reshape.array_to_frame(nested, "data", ["ix"], "v")) == [("r1", 1, 5), ("r1", 2, 0), ("r2", 1, 0), ("r2", 2, 8)]
    assert rows(reshape.array_to_frame(spark.createDataFrame([([[1, 2], [3, 4]],)], "a array<array<int>>"), "a", ["i", "j"]))[1] == (1, 2, 2)
    assert rows(reshape.frame_to_array(df, [["r"], ["c"]], None), "data") == [(False,), (False,), (True,), (True,)]
    assert rows(reshape.frame_to_array(df, [["r"], []], "v", order_col="o")) == [("r1", 5), ("r2", 8)]
    nulls = spark.createDataFrame([("a", "b", None)], "r string, c string, v int")
    assert rows(reshape.frame_to_array(nulls, [["r"], ["c"]], "v", missed=-1)) == [("a", "b", -1)]


def test_levels(spark):
    df = spark.createDataFrame([("lo",), ("hi",), (None,)], "x string")
    t = reshape.level_table(df, "x", ["lo", "hi"])
    assert rows(reshape.encode(df, "x", t)) == [("hi", 2), ("lo", 1), (None, None)]
    assert rows(reshape.decode(reshape.encode(df, "x", t).drop("x"), "x_code", t, "x"), "x") == [("hi",), ("lo",), (None,)]
    with pytest.raises(Exception, match="not among"):
        reshape.encode(df, "x", reshape.level_table(df, "x", ["lo"])).collect()
    assert reshape.match_levels({"x": t, "y": t}, {"x": 1}) == {"x": 1, "y": t}
    with pytest.raises(Exception, match="null in x"):
        reshape.to_nonnull(df, ["x"]).collect()


def test_subheatmap_guard(spark):
    df = spark.createDataFrame([("a", "c", "s", 1.0), ("a", "c", "s", 2.0)], "r string, c string, s string, value double")
    with pytest.raises(Exception, match="occurs twice"):
        reshape.subheatmap_frame(df, ["r"], ["c"], ["s"]).collect()


# --- sets


def test_sets(spark):
    df = spark.createDataFrame([("s", "a"), ("s", None), ("t", "a"), ("t", "b"), (None, "a"), (None, "c")], "s string, o string")
    assert rows(sets.frame_to_sets(df, "s", "o", 2)) == [("t", ["a", "b"]), (None, ["a", "c"])]
    assert rows(sets.set_members(df, "s", "o", 2)) == [("t", "a"), ("t", "b"), (None, "a"), (None, "c")]
    coll = spark.createDataFrame([("t", "k")], "s string, coll_id string")
    assert rows(sets.sets_to_frame(sets.frame_to_sets(df, "s", "o", 2), "s", "o", coll), "o", "coll_id")[:2] == [("a", "k"), ("a", None)]
    info = spark.createDataFrame([("t", "GO")], "term_id string, src string")
    assert rows(sets.group_by_source(info, df.withColumnRenamed("s", "term_id")), "coll_id", "o") == [("GO", "a"), ("GO", "b")]


def test_cascade(spark):
    df = spark.createDataFrame([("t", "s1", -5.0), ("t", "s2", -1.0), ("u", "s1", -1.0), ("v", "s1", None)], "t string, s string, p double")
    assert rows(sets.filter_multicover(df, ["t"], ["s"], "p")) == [("t", "s1", -5.0)]
    assert rows(sets.filter_multicover(df, ["t"], ["s"], "p", max_set_pvalue=1.0)) == [("t", "s1", -5.0), ("t", "s2", -1.0)]


def test_tightening(spark):
    df = spark.createDataFrame([(f"s{k}", -float(k) / 4, 3) for k in range(1, 41)], "s string, p double, n int")
    kept, low, high = sets.automask(df, "s", "p", "n", max_sets=5)
    assert kept.select("s").distinct().count() <= 5 and low == -2 - 0.5 * round((-2 - low) / 0.5) and high == low + 1
    assert df.where(F.col("p") <= low + 0.5).count() > 5
    assert sets.autoweight(df, "s", "p", max_sets=100)[0].count() == 40
    both = sets.set_counts(df.select("s", F.lit("x").alias("o")), spark.createDataFrame([("x",)], "o string"), spark.createDataFrame([("x",), ("y",)], "o string"), "s", "o")
    assert rows(both.limit(1), "n_both", "n_ref", "n_obs", "n_all", "n_hit") == [(1, 1, 1, 2, 2)]
    assert rows(sets.with_pvalue(both.limit(1), "n_both", "n_obs", "n_hit", "n_all"), "log10_pvalue") == [(0.0,)]


# --- graphs and proteins


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1)] + [(100 + k, 101 + k) for k in range(60)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "src int, dst int"))))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | {100 + k: 100 for k in range(61)}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).collect() == []


def brute_groups(links):
    """Parsimony by sets of Python, all peptides decisive."""
    peps = {}
    for pep, prot in links:
        peps.setdefault(prot, set()).add(pep)
    rep = {p: min(q for q in peps if peps[q] == peps[p]) for p in peps}
    reps = set(rep.values())
    tops = {r for r in reps if not any(peps[r] < peps[q] for q in reps)}
    groups = {}
    for t in tops:
        prots = {p for p in peps if peps[p] <= peps[t]}
        groups[t] = (prots, set().union(*(peps[p] for p in prots)))
    out = []
    for t in sorted(groups):
        prots, pp = groups[t]
        spec = {p for p in pp if sum(p in g[1] for g in groups.values()) == 1}
        major = {p for p in prots if sum(p in g[0] for g in groups.values()) == 1}
        if spec:
            out.append((sorted(major), sorted(prots), sorted(spec), sorted(pp)))
    return out


def test_protein_groups(spark):
    links = [("p1", "A"), ("p1", "B"), ("p2", "A"), ("p2", "B"), ("p2", "C"), ("p3", "D"), ("p4", "D")]
    got = proteins.group_records(proteins.assemble_protgroups(spark.createDataFrame([(*x, 1) for x in links], "pep string, prot string, rank int"))).orderBy("group_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_groups(links)
    assert got[0]["prots"] == ["A", "B", "C"] and got[0]["spec_peps"] == ["p1", "p2"]
    table = proteins.group_table(proteins.assemble_protgroups(spark.createDataFrame([(*x, 1) for x in links], "pep string, prot string, rank int")), ranks=spark.createDataFrame([("C", 1)], "item string, rank int"))
    assert table.orderBy("protgroup_id").first()["protein_acs"] == "C;A;B"


@pytest.mark.parametrize("seed", [1, 2])
def test_protein_groups_random(spark, seed):
    rng = np.random.default_rng(seed)
    links = sorted({(f"p{rng.integers(14):02d}", f"Q{rng.integers(18):02d}") for _ in range(45)})
    got = proteins.group_records(proteins.assemble_protgroups(spark.createDataFrame([(*x, 1) for x in rng.permutation(links).tolist()], "pep string, prot string, rank int"))).orderBy("group_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_groups(links)


def test_protein_groups_by_rank(spark):
    # a peptide of rank 2 is not decisive where the protein has rank 1, one of rank 0 never
    links = [("p1", "A", 1), ("p2", "A", 2), ("p1", "B", 1), ("p3", "A", 0), ("p4", "Z", 0)]
    got = proteins.group_records(proteins.assemble_protgroups(spark.createDataFrame(links, "pep string, prot string, rank int"))).collect()
    assert len(got) == 1 and got[0]["prots"] == ["A", "B"] and got[0]["peps"] == ["p1", "p2", "p3"]


def test_matching(spark):
    schema = "row_ix int, majority_protein_acs string, protein_acs string, gene_names string, is_reverse boolean"
    a = spark.createDataFrame([(1, "A;B", "A;B;C", "g;h", False), (2, "D", "D", "k", False)], schema)
    b = spark.createDataFrame([(1, "B", "B;C", "h", None), (2, "X", "X", None, True)], schema)
    pen = spark.createDataFrame([("B", 0), ("A", 5)], "ac string, penalty int")
    with_pen = proteins.match_protgroups({"a": a, "b": b}, pen)
    got = {(r["rowix_a"], r["rowix_b"]): r for r in with_pen.collect()}
    assert set(got) == {(1, 1), (2, None), (None, 2)}
    assert got[1, 1]["majority_protein_acs"] == "B" and got[1, 1]["protein_acs"] == "B;C" and got[1, 1]["gene_names"] == "h" and got[None, 2]["is_reverse"] is True
    refs = {(r["ac"], r["pg_rank"]): (r["row_ix"], r["ac_rank"]) for r in proteins.protgroup_refs(a, pen).collect()}
    assert refs["A", 0] == (1, 5) and refs["D", 0] == (2, 6)
    with pytest.warns(UserWarning):
        assert "gene_names" not in proteins.match_protgroups({"a": a, "b": b.drop("gene_names")}).columns


def test_cross_references(spark):
    df = spark.createDataFrame([("A;B;C", None, "B;C;D", {"C": 0.0, "B": 1.0})], "x string, y string, z string, m map<string,double>")
    cols = [F.col(c) for c in "xyz"]
    assert df.select(proteins.intersect_lists(*cols), proteins.intersect_lists(*cols, order=F.col("m")), proteins.intersect_lists(F.lit("a"), F.lit("b"))).first()[:] == ("B;C", "C;B", None)
    ranks = [F.lit(None).cast("int"), F.lit(2), F.lit(1)]
    assert df.select(proteins.best_rank(*ranks), proteins.worst_rank(*ranks), proteins.best_rank(ranks[0])).first()[:] == (1, 2, -1)
    n, i = F.lit(None).cast("int"), F.lit
    assert df.select(proteins.compatible([i(1), n], [i(1), i(2)]), proteins.compatible([i(1), n], [n, i(2)]), proteins.compatible([i(1), i(3)], [i(1), i(2)])).first()[:] == (True, False, False)
    assert df.select(proteins.any_flag(F.lit(None).cast("boolean"), F.lit(True))).first()[0] is True


def test_annotations(spark):
    a = spark.createDataFrame([(1, "P", 5, "S", "p", "x"), (2, "P", 5, "S", "p", "y"), (3, None, 1, "S", "p", "z")], "row_ix int, protein_ac string, ptm_pos int, ptm_AA string, ptm_code string, dis string")
    b = spark.createDataFrame([(1, "P", 5, "S", "K1"), (2, "Q", 9, "T", "K2")], "row_ix int, protein_ac string, ptm_pos int, ptm_AA string, kin string")
    got = proteins.combine_annotations({"dis": a, "kin": b}, {"dis": ["dis"], "kin": ["kin"]})
    assert rows(got, "protein_ac", "ptm_pos", "ptm_code", "dis", "kin") == [("P", 5, "p", "x; y", "K1"), ("Q", 9, None, None, "K2")]


# --- modified sequences


def test_extraction(spark):
    df = spark.createDataFrame([(1, "_AS(Phospho (S))K_"), (2, "_(Acetyl (Protein N-term))AM(Oxidation (M))SK_"), (3, "_AK_")], "pepmod_id int, pepmod_seq string")
    got = rows(ptm.extract_ptms(df, selected="Phos"))
    assert got == [(1, "ASK", "Phospho", "S", "S", 1, True), (2, "AMSK", "Acetyl", "Protein N-term", "_", -1, False), (2, "AMSK", "Oxidation", "M", "M", 1, False)]
    assert rows(ptm.ptm_stats(df, selected="Phos")) == [(1, 1, 1), (2, 2, 0), (3, 0, 0)]
    dia = spark.createDataFrame([(1, "_AS[Phospho (S)]K_")], "pepmod_id int, pepmod_seq string")
    assert rows(ptm.extract_ptms(dia, "spectronaut"), "ptm_type", "ptm_offset") == [("Phospho", 1)]


def test_probabilities(spark):
    df = spark.createDataFrame([(1, 1, 1, "Phospho", "AS(0.9)S(0.1)K", "_AS(Phospho (S))SK_"), (2, 1, 1, "Phospho", None, "_K_")], "report_ix int, pepmodstate_id int, rawfile_ix int, ptm_type string, ptm_locprob_seq string, m string")
    assert rows(ptm.extract_ptm_locprobs(df), "ptm_AA_seq", "ptm_offset", "ptm_locprob") == [("S", 1, 0.9), ("S", 2, 0.1)]
    assert rows(ptm.extract_ptm_locprobs(df, modseq_col="m"), "ptm_offset", "ptm_locprob") == [(1, 0.9)]
    with pytest.raises(Exception, match="contradicts"):
        ptm.extract_ptm_locprobs(df.withColumn("ptm_type", F.lit("Other")), modseq_col="m").collect()


def test_peptides(spark):
    df = spark.createDataFrame([(1, "A;B", "3,9;5")], "peptide_id int, protein_acs string, peptide_poses string")
    assert rows(ptm.peptide_matches(df)) == [(1, "A", 3), (1, "A", 9), (1, "B", 5)]
    with pytest.raises(Exception, match="differ in length"):
        ptm.peptide_matches(df.withColumn("peptide_poses", F.lit("3"))).collect()
    peps = spark.createDataFrame([(1, "P;Q;R", "_AA_"), (2, "P", "ZZ")], "peptide_id int, protein_acs string, peptide_seq string")
    seqs = spark.createDataFrame([("P", "AAAAKAA"), ("Q", "K")], "protein_ac string, seq string")
    assert rows(ptm.match_peptides(peps, seqs)) == [(1, "P", 1), (1, "P", 3), (1, "P", 6)]
    assert rows(ptm.ptm_sites(seqs, {"x": "K"})) == [("P", "x", 5, "K"), ("Q", "x", 1, "K")] and ptm.ptm_sites(seqs).count() == 8


def brute_score(a, b, score, open_=-10, ext=-1):
    """Best global score by exhaustive states."""
    n, m = len(a), len(b)
    best = {(0, 0): (0, -1e9, -1e9)}
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if i == j == 0:
            continue
        d = max(best[i - 1, j - 1]) + score(a[i - 1], b[j - 1]) if i and j else -1e9
        u = max(max(best[i - 1, j][0], best[i - 1, j][2]) + open_ + ext, best[i - 1, j][1] + ext) if i else -1e9
        r = max(max(best[i, j - 1][0], best[i, j - 1][1]) + open_ + ext, best[i, j - 1][2] + ext) if j else -1e9
        best[i, j] = (d, u, r)
    return max(best[n, m])


def test_alignment():
    score = align.class_scores()
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("AGST"), rng.integers(1, 9))) for _ in range(2))
        s, to, columns, matches, _ = align.align(a, b, score)
        assert s == round(brute_score(a, b, score))
        placed = [t for t in to if t]
        assert placed == sorted(placed) and matches == sum(t and a[i] == b[t - 1] for i, t in enumerate(to)) and columns == len(a) + len(b) - len(placed)
    table = align.read_score_matrix("# x\n   A  G\nA  4 -2\nG -2  6\n")
    assert table("A", "G") == -2 and table("G", "G") == 6 and table("A", "Z") == -2


def test_mapping_and_groups(spark):
    core = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"
    seqs = spark.createDataFrame([("P1", 1, 1, core), ("P1-2", 1, 2, core[5:]), ("Q", 2, 1, "AAAASAAA")], "protein_ac string, protgroup_id int, seq_rank int, seq string")
    objs = spark.createDataFrame([("Phospho", "P1-2", 8, "S"), ("Phospho", "Q", 5, "S")], "ptm_type string, protein_ac string, ptm_pos int, ptm_AA string")
    assert core[12] == "S" and core[5:][7] == "S"
    m = ptm.map_positions(objs.withColumn("ptm_id", F.monotonically_increasing_id()), seqs, seqs, "protgroup_id", self_matches=False)
    assert rows(m, "protein_ac", "agn_seqid", "agn_pos", "agn_match") == [("P1-2", "P1", 13, "="), ("Q", None, None, None)]
    g = ptm.group_objects(objs, seqs)
    got = {(r["protein_ac"], r["ptm_pos"]): (r["is_observed"], r["is_reference"], r["ptm_label"]) for r in g.collect()}
    assert got == {("P1", 13): (False, True, "Phospho_1_S13"), ("P1-2", 8): (True, False, "Phospho_1_S13"), ("Q", 5): (True, True, "Phospho_2_S5")}
    assert len({r["ptm_id"] for r in g.collect()}) == 2
    assert rows(ptm.group_objects(objs, seqs, force_refseqs=False), "protein_ac") == [("P1-2",), ("Q",)]


def test_set_groups_and_ptm_groups(spark):
    df = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("t", 2, "b"), ("t", 2, "a"), ("t", 3, "a"), ("u", 4, "a")], "g string, s int, e string")
    assert rows(ptm.set_groups(df, "s", "e", ["g"])) == [("t", 1, 1), ("t", 1, 2), ("t", 2, 3), ("u", 3, 4)]
    links = spark.createDataFrame([(1, 11, "P", 1, 100, 1000, 3), (2, 12, "P", 1, 100, 1000, 3), (3, 12, "P", 1, 101, 1001, 4), (4, 14, "P", 1, 200, 2000, 1)], "ptm_id int, ptmn_id int, ptm_type string, nselptms int, peptide_id int, pepmodstate_id int, ptm_offset int")
    a, b, both = ptm.ptm_groups(links)
    group = {r["ptm_id"]: r["ptmgroup_id"] for r in a.collect()}
    assert group[2] == group[3] and set(group.values()) == set(range(1, len(set(group.values())) + 1)) and group[4] != group[1]
    per = {}
    for r in both.collect():
        per.setdefault(r["ptmngroup_id"], set()).add(r["ptmgroup_id"])
    assert all(len(v) == 1 for v in per.values())


def test_sets_are_told_by_sums(spark, monkeypatch):
    """Nulls, repeats and elements of several columns; no list of a set is made."""
    monkeypatch.setattr(ptm.F, "collect_set", None)
    df = spark.createDataFrame([("t", 1, "a", None), ("t", 1, None, "a"), ("t", 2, "a", None), ("t", 2, "a", None), ("t", 3, None, "a"), ("t", 4, None, None), ("t", 5, None, None), (None, 6, "a", None)], "g string, s int, e string, f string")
    assert rows(ptm.set_groups(df, "s", "e", ["g"])) == [("t", 1, 1), ("t", 1, 2), ("t", 2, 3), ("t", 2, 4), ("t", 2, 5)]
    assert rows(ptm.set_groups(df, "s", ["e", "f"], ["g"])) == [("t", 1, 1), ("t", 2, 2), ("t", 3, 3), ("t", 4, 4), ("t", 4, 5)]


# --- networks


def test_network(spark):
    fi = spark.createDataFrame([("A", "B", 0.5, "->")], "gene1 string, gene2 string, score double, direction string")
    dirs = spark.createDataFrame([("->", "s", "t", 1, 0)], "direction string, source string, target string, src_to_dest int, dest_to_src int")
    assert rows(network.directed_edges(fi, dirs)) == [("A", "B", 0.5, "->", "t", False)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "source int, target int")
    assert rows(network.vertex_degrees(e)) == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 0)]
    strong = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("w"))
    assert dict(rows(network.strong_components(strong, 0.5))) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert rows(network.weighted_matrix(spark.createDataFrame([(1, 2, 0.5)], "i int, j int, v double"), spark.createDataFrame([(2, 4.0)], "j int, weight double"))) == [(1, 2, 2.0)]


def test_restart_walk(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "source int, target int")
    starts = spark.createDataFrame([(0,), (1,)], "start int")
    w = np.array([[0, 0, 1], [0.5, 0, 0], [0.5, 1, 0]])
    p = 0.4 * np.linalg.inv(np.eye(3) - 0.6 * w)
    got = {(r["start"], r["vertex"]): r["p"] for r in network.restart_walk(e, starts, 0.4, 1e-6).collect()}
    assert all(abs(got.get((s, v), 0) - p[v, s]) < 1e-3 for s in (0, 1) for v in range(3))
    s = rows(network.walk_weight_stats(e, starts, [0.4], tolerance=1e-5))
    assert s[0][1] == "exterior" and s[1][2] == pytest.approx((p[1, 0] + p[2, 0] + p[2, 1]) / 2, abs=1e-3)


def test_walks_keep_thin_mass(spark):
    """A start with so many ways out that each takes little."""
    e = spark.range(1, 4001).select(F.lit(0).alias("source"), F.col("id").cast("int").alias("target"))
    starts = spark.createDataFrame([(0,)], "start int")
    s = {r["vertices"]: r["trans_probs"] for r in network.walk_weight_stats(e, starts, [0.5], tolerance=0.4).collect()}
    assert s == {"neighbors": pytest.approx(0.25), "exterior": 0.0}
    thin = network.restart_walk(e, starts, 0.5, 0.4).where("vertex > 0").agg(F.count("*"), F.sum("p")).first()
    assert (thin[0], thin[1]) == (4000, pytest.approx(0.25))


def test_flow_graph(spark):
    v = spark.createDataFrame([(1, 1, True, True, False, [2, 2]), (2, 1, False, False, True, None), (3, 1, False, False, False, [])], "vertex int, component int, is_source boolean, is_sink boolean, is_steptrace boolean, flows_to array<int>")
    labels = spark.createDataFrame([(2, "g2")], "vertex int, label string")
    out = {r["node"]: r for r in network.flow_vertices(v, labels=labels).collect()}
    assert [out[k]["vertex_type"] for k in ("v1", "v2", "v3", "g1")] == ["source/sink", "step", "gene", "connected_component"] and out["v1"]["flows_to_genes"] == "g2(2)"
    e = spark.createDataFrame([(1, 2, True, False, True, True, False, 0.01, None, [["x", "y"], []], 2.0, None), (2, 2, True, False, True, True, False, 0.01, None, None, 1.0, None), (2, 3, False, False, False, False, True, None, None, None, 4.0, 1.0)], "source int, target int, has_original boolean, has_original_rev boolean, has_trace boolean, has_walk boolean, has_flow boolean, prob_perm_walkweight_greater double, prob_perm_walkweight_greater_rev double, flowpaths array<array<string>>, walkweight double, walkweight_rev double")
    edges = network.flow_edges(e, True)
    assert rows(edges, "source", "target", "edge_type", "mlog10_prob_perm_walkweight_greater", "flowpaths") == [(1, 2, "trace", 2.0, "→x→y→"), (2, 3, "flow", 0.0, None)]
    nodes, weighted = network.layout_weights(network.flow_vertices(v, component_groups=False), edges)
    w = {(r["source"], r["target"]): r["layout_weight"] for r in weighted.collect()}
    assert w[1, 2] == pytest.approx((2 / 3) ** 0.25 * 10) and w[2, 3] == pytest.approx((4 / 3) ** 0.25 * 1.0)
    assert rows(nodes, "vertex", "ninedges", "noutedges", "anyoriginal_edge") == [(1, 0, 1, True), (2, 1, 1, True), (3, 1, 0, False)]
    n, _ = network.graph_frames(network.flow_vertices(v), edges)
    assert n.columns[:2] == ["node", "component_node"] and "vertex_type" in n.columns and "is_source" not in n.columns


# --- matrices


def test_heatmap_and_order(spark):
    df = spark.createDataFrame([("a", "x", -3.0, 2), ("b", "x", -1.0, 0), ("b", "y", -2.0, 1)], "t string, e string, set_original_weight double, nmasked int")
    cells = matrices.heatmap_cells(df, ["t"], ["e"])
    assert [(r[0], r[1], None if math.isnan(r[2]) else r[2]) for r in rows(cells, "t", "e", "score")] == [("a", "x", -3.0), ("a", "y", None), ("b", "x", None), ("b", "y", -2.0)]
    order = lambda o: [r["member"] for r in matrices.axis_places(cells, "t", "e", order=o).orderBy("place").collect()]
    assert order(None) == ["a", "b"] and order(["b", "z"]) == ["b"] and order(lambda m: m[::-1]) == ["b", "a"] and sorted(order("hclu")) == ["a", "b"]
    with pytest.raises(ValueError):
        order("x")
    assert matrices.cosine_distances(cells, "t", "e").count() == 1
    real = spark.createDataFrame([(0.1, 2.0, 0.1), (0.2, 4.0, 99.0), (0.9, 100.0, 1.0)], "threshold double, m double, m_975 double")
    deltas = spark.createDataFrame([("s", "v", 0.1, 1.0, 2.0, -1.0), ("s", "v", 0.2, 1.0, 4.0, 3.0)], "stat string, value_type string, threshold double, value double, permuted_value double, delta double")
    a, _, best = matrices.permutation_traces(real, real, deltas, "threshold", "m", (0.0, 0.5))
    assert rows(a) == [(0.1, 2.0, 1.0), (0.2, 4.0, 8.0)] and best.first()["threshold"] == 0.2


# --- noise and calibration

MODEL = noise.NoiseModel(0.7, 5.0, 1.2, 2.0, 0.99, 1.1, 0.4, -0.3, 0.2, 0.5, logintensityBase=2.0)


def test_model(spark):
    d = MODEL.to_dict()
    assert noise.NoiseModel.from_dict(json.loads(json.dumps(d))) == MODEL and "P(outlier)=0.0001" in str(MODEL) and "Log₂" in str(MODEL)
    for bad in ({"zScale": 0.0}, {"detectionMax": 1.5}, {"sigmaSmooth": -1.0}, {"outlierProb": 0.0}, {"logintensityBase": 1.0}):
        with pytest.raises(ValueError):
            noise.NoiseModel.from_dict(d | bad)
    other = MODEL.with_base(10.0)
    df = spark.createDataFrame([(v,) for v in (3.0, 40.0, 900.0)], "v double")
    for r in df.select(MODEL.zscore(F.col("v")), other.zscore(F.col("v")), MODEL.signal_std(F.col("v")), other.signal_std(F.col("v"))).collect():
        assert r[0] == pytest.approx(r[1]) and r[2] > 0 and r[3] > 0
    assert df.select(MODEL.zscore(F.lit(float("inf")))).first()[0] != df.select(MODEL.zscore(F.lit(float("inf")))).first()[0]
    t = MODEL.distr.threshold
    u = (1 + t * t) / 2
    assert u * math.exp(-u) == pytest.approx(1e-4 / (1 - 1e-4) / math.sqrt(2 * math.pi * math.e))
    with pytest.raises(ValueError):
        noise.GaussCauchyMix(outlier_prob=1.0)
    sim = MODEL.simulate(df.withColumn("x", F.when(F.col("v") > 5, F.col("v"))), "x", "v").collect()
    assert len(sim) == 3 and all(math.isfinite(r["simulated"]) for r in sim)


def test_channels_and_objects(spark):
    ch = spark.createDataFrame([("r1", "e"), ("r2", "e"), ("r3", "f")], "msrun string, experiment string")
    assert rows(calib.used_channels(ch), "msrun") == [("r1",), ("r2",)]
    obs = spark.createDataFrame([(1, "A", 5.0), (1, "B", None), (2, "B", 1.0)], "pepmodstate_id int, ident_type string, intensity double")
    objs = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "pepmodstate_id int, peptide_id int")
    peps = spark.createDataFrame([(10, False, False), (11, True, False)], "peptide_id int, is_contaminant boolean, is_reverse boolean")
    assert rows(calib.pepmodstate_data(obs, objs, peps, allowed=["A"]), "pepmodstate_id", "use_for_calib") == [(1, True), (2, False)]
    assert rows(calib.protgroup_data(spark.createDataFrame([(1, 5.0)], ["id", "Intensity.r1"]), ["id"])) == [(1, "r1", 5.0)]


def test_prediction(spark):
    cells = spark.createDataFrame([("e", 1, 4.0, 4.0), ("e", 1, None, None), ("e", 1, 8.0, 8.0), ("e", 2, None, None)], "expchannel string, o int, intensity double, intensity_norm double")
    assert rows(calib.predicted(cells, "o", 0.5), "o", "intensity_norm_predicted", "intensity_norm_predicted_corr") == [(1, 6.0, 3.0)]


def test_calibration(spark, tmp_path):
    rng = np.random.default_rng(3)
    level = rng.uniform(4, 16, 300)
    data = [(i, f"r{r}", float(2 ** (level[i] + 0.5 * r + rng.normal(0, 0.1)))) for i in range(300) for r in range(3) if rng.random() < 0.9]
    x = spark.createDataFrame(data, "protgroup_id int, msrun string, intensity double")
    objs = x.select("protgroup_id").distinct().withColumn("use_for_calib", F.lit(True))
    ch = spark.createDataFrame([(f"r{r}", "e") for r in range(3)], "msrun string, experiment string")
    cal = calib.calibration_data(x, objs, ch, bins=6)
    shifts = {r["msrun"]: r["logshift"] for r in cal.shifts.collect()}
    assert shifts["r0"] == 0 and shifts["r1"] == pytest.approx(0.5, abs=0.05) and shifts["r2"] == pytest.approx(1.0, abs=0.05)
    assert len(cal.grid) == 6 and cal.used.count() > 50 and cal.zScale > 0
    model, fit = calib.calibrate(cal, rounds=15, population=12)
    assert math.isfinite(fit) and fit > -1e200
    rows_ = cal.used.toPandas()
    arrays = {"error": rows_["intensity_prediction_error"].to_numpy(float), "z": rows_["intensity_zscore_predicted"].to_numpy(float), "log": rows_["logintensity_predicted"].to_numpy(float)}
    whole = lambda m: calib.whole_llh(m, *calib.partial_llh(m, arrays))
    assert whole(model) == pytest.approx(calib.log_likelihood(model, cal), rel=1e-6)
    # the search over executors is the search over arrays
    factory = calib.ModelFactory(cal.zScale, cal.zShift, cal.base)
    pool = [factory.model(p) for p in np.random.default_rng(1).uniform(*np.array(list(factory.bounds.values())).T, (5, 8))]
    spread = cal.used.select(F.col("intensity_prediction_error").alias("error"), F.col("intensity_zscore_predicted").alias("z"), F.col("logintensity_predicted").alias("log")).repartition(5)
    assert calib.population_llh(spread, pool) == pytest.approx([whole(m) for m in pool], rel=1e-9)
    fitness = lambda ps: np.array([calib.bayesian_score(calib.log_prior(m, cal.grid, n=len(rows_)), whole(m)) for m in map(factory.model, ps)])
    best, score = calib.generations(list(factory.bounds.values()), lambda ps: np.where(np.isfinite(f := fitness(ps)), f, -1e300), 15, 12, 1)
    assert fit == pytest.approx(score, rel=1e-9) and factory.model(best).sigmaBend == pytest.approx(model.sigmaBend)
    assert calib.population_llh(spread.limit(0), pool[:1]) == [pytest.approx(calib.whole_llh(pool[0], 0.0, 0, 0))]
    path = f"{tmp_path}/{calib.calibration_file_prefix({'msinstrument': 'q', 'quanttype': 'l', 'quantobj': 'p', 'id': 1, 'calib_ver': 2})}.json"
    calib.save_result(path, model, fit, [1.0], {"id": 1})
    assert path.endswith("mscalib_q_l_p_1_2.json") and calib.load_model(path) == model
    with pytest.raises(ValueError):
        calib.save_result("x.jld2", model, fit, [])
    with pytest.raises(ValueError):
        calib.ModelFactory(1.0, 0.0).model([1.0])


def test_beta_density():
    assert calib.beta_logpdf(0.5, 2, 2) == pytest.approx(math.log(1.5)) and calib.beta_logpdf(1.5, 2, 2) == float("-inf")


def test_containments_of_a_hot_element(spark):
    """One peptide in 5,000 proteins makes no pairs of those that have another of their own."""
    rows = [(k, 0) for k in range(5000)] + [(k, k + 1) for k in range(4990)]
    df = spark.createDataFrame(rows, "id long, pep long")
    got = {(r["child"], r["parent"]) for r in proteins.containments(df, df).where("child >= 4990 and parent < 3 or child < 4990").collect()}
    assert got == {(c, p) for c in range(4990, 5000) for p in range(3)}
    groups = proteins.assemble_protgroups(df.select(F.col("id").alias("prot"), "pep", F.lit(1).alias("rank")).where("prot < 300 or prot > 4996"))
    assert groups.where("kind = 'pep' and item = '0'").count() == 300  # every group, and no group of the three that hold it alone


@pytest.mark.parametrize("merge", [0.0, 0.4])
def test_inference_by_either_path(spark, merge):
    """Containment alone and the relations of all pairs give the same groups where nothing merges."""
    rng = np.random.default_rng(3)
    rows = [(int(p), int(e), 1) for p in range(60) for e in rng.choice(40, rng.integers(1, 5), replace=False)]
    df = spark.createDataFrame(rows, "prot long, pep long, rank long")
    got = proteins.assemble_protgroups(df, rspec_peptides=merge, nspec_peptides=0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, proteins.assemble_protgroups(df).collect()))


def test_ranks_are_bettered_only_together(spark):
    """A reference that is better in one rank alone does not replace another."""
    a = spark.createDataFrame([(1, "B", "A;B")], "row_ix long, majority_protein_acs string, protein_acs string")
    b = spark.createDataFrame([(7, "A", "A")], "row_ix long, majority_protein_acs string, protein_acs string")
    penalties = spark.createDataFrame([("A", 2), ("B", 7)], "ac string, penalty long")
    r = proteins.match_protgroups({"a": a, "b": b}, penalties).collect()
    assert [(x["pgrank_a"], x["acrank_a"], x["pgrank_b"], x["acrank_b"]) for x in r] == [(1, 2, 0, 2)]


def plain_fold(rows, names):
    """All rows in order, each against all that are kept."""
    kept = []
    for r in sorted(rows):
        new = {n: ref for n, ref in zip(names, r[1:], strict=True) if ref}
        absorbed = False
        for old in kept:
            if any(n in old for n in new) and all(old[n][0] == new[n][0] for n in new if n in old):
                absorbed = True
                for n, ref in new.items():
                    if n not in old or (old[n][1] >= ref[1] and old[n][2] >= ref[2]):
                        old[n] = ref
        if not absorbed:
            kept.append(new)
    return [tuple(x.get(n, (None,) * 3) for n in names) for x in kept]


@pytest.mark.parametrize("most", [100_000, 9])
def test_absorption_in_batches(spark, most):
    """Small components in one go, a large one in batches of its order: the same rows as one after the other, a shared group or not."""
    rng = np.random.default_rng(11)
    names = ["a", "b", "c"]
    refs = lambda k: [(int(rng.integers(0, 9)) if rng.random() < 0.7 else 0, k % 2, int(rng.integers(0, 4))) if rng.random() < 0.6 else None for _ in names]
    rows = [(k, *r) for k in range(32) if any(r := refs(k))] + [(100 + k, (100 + k, 0, 1), (100 + k, 1, 1), None) for k in range(5)]
    flat = [(r[0], *[x for ref in r[1:] for x in (ref or (None,) * 3)]) for r in rows]
    df = spark.createDataFrame(flat, ", ".join(["id long", *[f"{k}_{n} long" for n in names for k in ("rowix", "pgrank", "acrank")]])).repartition(3)
    got = sorted((tuple(tuple(r[f"{k}_{n}"] for k in ("rowix", "pgrank", "acrank")) for n in names) for r in proteins.absorb(df, names, most).collect()), key=str)
    assert got == sorted(plain_fold(rows, names), key=str)


def test_axis_of_many_members(spark):
    """Only clustering has a limit."""
    df = spark.range(6000).select(F.col("id").alias("m"), F.lit(1).alias("o"), F.lit(1.0).alias("score"))
    assert matrices.axis_places(df, "m", "o", order=None).where("place = member + 1").count() == 6000
    assert [r["member"] for r in matrices.axis_places(df, "m", "o", order=list(range(5999, 5990, -1))).orderBy("place").collect()] == list(range(5999, 5990, -1))
    with pytest.raises(ValueError, match="more than"):
        matrices.axis_places(df, "m", "o")


def test_draws_hang_on_keys_alone(spark):
    """The same after any split; within the grid; tables of bins hold running sums; no signal, no draw."""
    df = spark.range(400).select("id", (F.col("id") + 1.0).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id") + 1.0).alias("x")).unionByName(spark.createDataFrame([(900, None, None), (901, 5.0, float("nan"))], "id long, v double, x double"))
    one = {r["id"]: r["s"] for r in MODEL.simulate(df.repartition(1), "x", "v", "s", keys=["id"]).collect()}
    other = {r["id"]: r["s"] for r in MODEL.simulate(df.repartition(7, "v"), "x", "v", "s", keys=["id"]).collect()}
    assert one == other and one[900] is None and all(math.isfinite(v) for k, v in one.items() if k != 900)
    assert {r["id"]: r["s"] for r in MODEL.simulate(df, "x", "v", "s", seed=2, keys=["id"]).collect()} != one
    t = MODEL.missing_table(spark, [1.0, 2.0], points=11).collect()
    assert [r["at"] for r in t] == [1.0, 2.0] and all(list(r["upto"]) == sorted(r["upto"]) and r["xs"][5] == pytest.approx(r["at"]) for r in t)
    u = [r[0] for r in spark.range(4000).select(noise.uniform(["id"], 1)).collect()]
    assert 0 <= min(u) and max(u) < 1 and np.histogram(u, 8, (0, 1))[0].min() > 400


def test_ward_by_chains():
    """Chains of nearest neighbours merge what the nearest pair of all merges; single leaves first, then earlier clusters."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(12, 5))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        dist = 1 - unit @ unit.T
        d = dist**2
        np.fill_diagonal(d, np.inf)
        leaves, size, live, made = [[i] for i in range(12)], np.ones(12), np.ones(12, bool), [-1] * 12
        for at in range(11):
            i, j = sorted(divmod(int(np.argmin(d)), 12))
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
            first, second = (leaves[j], leaves[i]) if made[j] < made[i] else (leaves[i], leaves[j])
            leaves[i], made[i] = first + second, at
            size[i] += size[j]
            live[j] = False
            new[~live] = new[i] = np.inf
            d[i] = d[:, i] = new
            d[j] = d[:, j] = np.inf
        assert matrices.ward_leaves(dist) == leaves[int(np.flatnonzero(live)[0])]
    far = np.full((4, 4), 100.0)
    far[0, 2] = far[2, 0] = 0.1
    assert matrices.ward_leaves(far) == [0, 2, 1, 3] and matrices.ward_leaves(np.ones((1, 1))) == [0] and matrices.ward_leaves(np.ones((0, 0))) == []


@pytest.mark.parametrize("block", [3, 512])
def test_distances_with_missing_cells(spark, block, monkeypatch):
    """Absent cells are 0; members of zeros alone, or with a NaN or null, are at 100; blocks and spans of columns change nothing."""
    monkeypatch.setattr(matrices, "SPAN", 4 if block == 3 else 1 << 16)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((10, 9)) < 0.5, rng.normal(size=(10, 9)), 0.0)
    x[3] = 0.0
    x[7, 2] = np.nan
    cells = [(f"m{i}", j, None if i == 7 and j == 2 else float(x[i, j])) for i in range(10) for j in range(9) if i == 3 or x[i, j] != 0]
    got = {(r["a"], r["b"]): r["distance"] for r in matrices.cosine_distances(spark.createDataFrame(cells, "m string, o int, score double"), "m", "o", block=block).collect()}
    assert set(got) == {(f"m{i}", f"m{j}") for i in range(10) for j in range(i + 1, 10)}
    for (a, b), d in got.items():
        u, v = x[int(a[1])], x[int(b[1])]
        length = np.linalg.norm(u) * np.linalg.norm(v)
        assert d == pytest.approx(1 - u @ v / length if length > 0 else 100.0)
    assert matrices.cosine_distances(spark.createDataFrame([], "m string, o int, score double"), "m", "o").collect() == []


def test_ordered_heatmap(spark):
    df = spark.createDataFrame([("a", "x", -9.0, 2), ("b", "y", -4.0, 1), ("c", "x", -4.0, 1), ("c", "y", -1.0, 2), ("d", "y", -1.0, 0)], "t string, e string, set_original_weight double, nmasked int")
    got = rows(matrices.ordered_heatmap(matrices.heatmap_cells(df, ["t"], ["e"]), "t", "e", column_order=["y"]), "t", "e", "row_place", "column_place")
    places = {t: p for t, _, p, _ in got}
    assert len(got) == 8 and {(e, c) for _, e, _, c in got} == {("x", None), ("y", 1)} and sorted(places.values()) == [1, 2, 3, 4]
    assert abs(places["a"] - places["c"]) == 1  # their roots point almost the same way; d, which has no score, is at 100 from all


def test_alignment_columns():
    from massloom.operators.align import align, class_scores

    s, to, columns, matches, at = align("MKTAYIAK", "MKYIAK", class_scores(), -2, -1)
    assert columns == 8 and matches == 6 and to.tolist() == [1, 2, 0, 0, 3, 4, 5, 6] and at.tolist() == list(range(1, 9))
    assert align("AC", "XXAC", class_scores(), -2, -1)[4].tolist() == [3, 4]


def test_alignment_in_bounded_memory():
    """The way back by blocks of rows costs what the score says, in memory far below one cell a pair of residues."""
    import tracemalloc

    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 5000))
    b = a[:700] + a[760:2000] + "".join(rng.choice(list("ACDEF"), 90)) + a[2000:4400] + "WW" + a[4410:]
    tracemalloc.start()
    total, to, columns, matches, at = align.align(a, b, align.blosum90())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 < len(a) * len(b)  # a byte for each cell would be 25 MB
    score = align.blosum90()
    paired = [(i, int(j) - 1) for i, j in enumerate(to) if j]
    cost = sum(score(a[i], b[j]) for i, j in paired)
    for (i, j), (k, m) in zip([(-1, -1), *paired], [*paired, (len(a), len(b))], strict=True):
        cost += sum(-10 - gap for gap in (k - i - 1, m - j - 1) if gap)
    assert cost == total and columns == len(a) + len(b) - len(paired) and matches > 4800 and sorted(set(at)) == sorted(at)


def test_blosum():
    score = align.blosum90()
    residues = "ARNDCQEGHILKMFPSTWYVBZX*"
    assert all(score(x, y) == score(y, x) for x in residues for y in residues) and all(score(x, x) > max(score(x, y) for y in residues[:20] if y != x) for x in residues[:20])
    assert score("A", "?") == -6


def test_graphs_by_either_path(spark):
    """One task, or rounds over all: the same components."""
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))]
    df = spark.createDataFrame(pairs, "src long, dst long")
    named = df.selectExpr("concat('v', src) as src", "concat('v', dst) as dst")
    assert sorted(map(tuple, graph.connected_components(df).collect())) == sorted(map(tuple, graph.connected_components(df, one_task=0).collect()))
    assert sorted(map(tuple, graph.connected_components(named).collect())) == sorted(map(tuple, graph.connected_components(named, one_task=0).collect()))
    reach = np.eye(60, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for _ in range(6):
        reach = reach @ reach
    edges = [(a, b) for a, b in pairs if a != b]
    want = {v: int(np.flatnonzero(reach[v] & reach[:, v]).min()) for v in {x for e in edges for x in e}}
    weighted = df.withColumn("w", F.lit(1.0))
    assert dict(map(tuple, network.strong_components(weighted, 0.5).collect())) == want == dict(map(tuple, network.strong_components(weighted, 0.5, one_task=0).collect()))


@pytest.mark.parametrize("kind", ["chain", "stars", "pairs", "random"])
def test_components_contract(spark, monkeypatch, kind):
    """Edges of numbers get few in a few steps, whatever the shape; repeated edges, loops and negative numbers too."""
    rng = np.random.default_rng(4)
    n = 400
    ends = {"chain": [(k, k + 1) for k in range(n)], "stars": [(k, 1000 + k % 7) for k in range(n)] + [(1000 + k, -1) for k in range(6)], "pairs": [(2 * k, 2 * k + 1) for k in range(n)], "random": [tuple(x) for x in rng.integers(-200, 200, (n, 2)).tolist()]}[kind]
    df = spark.createDataFrame(ends + ends[:50] + [(7777, 7777), (3, 3)], "src long, dst long")
    made, whole = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda d, name="table": made.append(name) or whole(d, name))
    got = sorted(map(tuple, graph.connected_components(df, one_task=20).collect()))
    steps = made.count("steps")
    assert got == sorted(map(tuple, graph.connected_components(df).collect())) and (7777, 7777) in got
    assert 1 <= steps <= {"chain": 14, "stars": 2, "pairs": 2, "random": 6}[kind]


def test_strong_components_contract(spark, monkeypatch):
    """Vertices with edges both ways are one, and ends that lead on are alone: labels go round by round over what is left only."""
    both = [(k, 1000 + k % 9) for k in range(200)]
    edges = both + [(b, a) for a, b in both] + [(1000 + k, 2000 + k % 2) for k in range(9)] + [(2000, 3000)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5000, 1000)]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "src long, dst long, w double")
    made, whole = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda d, name="table": made.append(name) or whole(d, name))
    got = sorted(map(tuple, network.strong_components(df, 0.5, one_task=10).collect()))
    assert "label" not in made
    assert got == sorted(map(tuple, network.strong_components(df, 0.5).collect())) and dict(got)[1002] == 0 and dict(got)[5000] == 5000


@pytest.mark.parametrize("fractions", [False, True])
def test_states_are_ranked_once(spark, monkeypatch, fractions):
    """Both ids come of one order, in which nulls are last; the states are written twice and rows never."""
    rng = np.random.default_rng(6)
    data = [(int(p) or None, "abc"[s] if s < 3 else None, int(f) if fractions else None, int(c) or None) for p, s, f, c in rng.integers(0, [9, 4, 2, 4], (150, 4))]
    made, whole = [], ids.materialize
    monkeypatch.setattr(ids, "materialize", lambda d, name="table": made.append(name) or whole(d, name))
    got = ids.update_pepmodstates(spark.createDataFrame(data, "peptide_id int, pepmod_seq string, msfraction int, charge int").repartition(5)).collect()
    key = lambda *xs: tuple((x is None, "" if x is None else x) for x in xs)
    mods = {k: n for n, k in enumerate(sorted({key(p, s) for p, s, _, _ in data}))}
    states = {k: n for n, k in enumerate(sorted({key(*r) for r in data}))}
    assert len(got) == len(data) and made == ["states", "states"]
    assert all(r["pepmod_id"] == mods[key(r["peptide_id"], r["pepmod_seq"])] and r["pepmodstate_id"] == states[key(r["peptide_id"], r["pepmod_seq"], r["msfraction"], r["charge"])] for r in got)


def test_few_candidates_are_compared(spark, monkeypatch):
    """Sets that share the rarest element alone are told apart by their bits, and those with an element of their own never meet another."""
    links = [(i, f"common{i // 2}") for i in range(200)] + [(i, f"e{i}-{k // 2}" if i % 2 else f"e{i}-{k}") for i in range(200) for k in range(6)]
    links += [(i + 1000 * j, e) for i, e in links if i < 20 for j in (1, 2) if j == 1 or not e.endswith("5")]
    df = spark.createDataFrame(links, "id long, pep string").distinct()
    made, whole = {}, proteins.materialize
    monkeypatch.setattr(proteins, "materialize", lambda d, name="table": made.setdefault(name, whole(d, name)))
    got = set(map(tuple, proteins.containments(df, df).collect()))
    sets = {}
    for i, e in links:
        sets.setdefault(i, set()).add(e)
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    assert got == want and made["candidates"].count() < len(want) + 20
    assert made["decisive"].select("child").distinct().count() < 70  # the 180 without copies are in no other


def test_protein_groups_of_numbers(spark):
    """Numbers are ids themselves, repeated links and nulls included: the same groups as by names."""
    rng = np.random.default_rng(8)
    links = [(int(p), int(q), int(r)) for p, q, r in zip(rng.integers(0, 14, 60), rng.integers(0, 18, 60), rng.integers(0, 3, 60), strict=True)] + [(None, 3, 1), (3, None, 1)]
    df = spark.createDataFrame(links + links[:9], "pep int, prot int, rank int")
    named = df.selectExpr("lpad(pep, 3, '0') as pep", "lpad(prot, 3, '0') as prot", "rank")
    got = sorted((g, k, i and i.zfill(3)) for g, k, i in map(tuple, proteins.assemble_protgroups(df).collect()) if i)
    assert got == sorted(t for t in map(tuple, proteins.assemble_protgroups(named).collect()) if t[2]) and got


def test_distances_come_by_rows(spark, monkeypatch):
    """A row of a table has a row of a block, whatever the batch: whole blocks of 2 MB filled a task's memory."""
    entries = spark.createDataFrame([(i, o, 1.0 if i % 3 == o % 3 else 0.0) for i in range(10) for o in range(6)], "ix long, o long, x double")
    whole = matrices.distance_blocks(entries, 10, 4)
    assert {len(r["distances"]) for r in whole.collect()} == {4 * 8}
    want = sorted((r["i"], r["j"], r["row"], bytes(r["distances"])) for r in whole.collect())
    monkeypatch.setattr(matrices, "SPAN", 2)  # sums of three spans
    assert sorted((r["i"], r["j"], r["row"], bytes(r["distances"])) for r in matrices.distance_blocks(entries, 10, 4).collect()) == want


def test_distances_are_rounded_and_named_by_blocks(spark):
    """Rounding is that of ``F.round``, and pairs are not joined to names one by one: what is joined has a row for a member and a block."""
    cells = spark.createDataFrame([(f"m{i}" if i else None, o, 1.0 + (i * o) % 5) for i in range(11) for o in range(3)], "m string, o int, score double")
    got = matrices.cosine_distances(cells, "m", "o", block=4, digits=3)
    want = matrices.cosine_distances(cells, "m", "o", block=4).withColumn("distance", F.round("distance", 3))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 55
    x = [0.0, 0.0005, 0.0015, 1.0005, 2.6745, 0.1234999999, 100.0, 0.00149999999999999]
    assert list(matrices.half_up(np.array(x), 3)) == [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double").orderBy("k").select(F.round("v", 3)).collect()]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join")  # rows of pairs are made above the joins


@pytest.mark.parametrize("self_matches", [True, False])
def test_copies_of_a_text_make_no_pairs_of_proteins(spark, monkeypatch, self_matches):
    """200 proteins of two texts in one group: nothing that is written has a row for each pair of them."""
    seqs = spark.createDataFrame([(f"P{k:03}", "g", "MKSWVTFR" if k % 2 else "MKSWTFR", 1) for k in range(200)], "protein_ac string, protgroup_id string, seq string, seq_rank int")
    objs = spark.createDataFrame([("Phospho", f"P{k:03}", 3, "S") for k in range(0, 200, 3)], "ptm_type string, protein_ac string, ptm_pos int, ptm_AA string")
    sizes, write = [], ptm.materialize
    monkeypatch.setattr(ptm, "materialize", lambda df, name="table": (lambda out: sizes.append(out.count()) or out)(write(df, name)))
    got = ptm.group_objects(objs, seqs, self_matches=self_matches).collect()
    assert max(sizes) <= 1000
    assert {r["ptm_id"] for r in got} == {1} and sorted(r["protein_ac"] for r in got if r["is_observed"]) == [f"P{k:03}" for k in range(0, 200, 3)]
    sizes.clear()
    places = ptm.map_positions(objs, seqs, seqs, "protgroup_id", objid_cols=["ptm_type"], self_matches=self_matches)
    assert max(sizes) <= 1000 and places.count() == 67 * (200 if self_matches else 199)
    assert rows(places.select("agn_pos", "agn_match").distinct()) == [(3, "=")]


def test_pairs_are_dealt_to_more_tasks_as_they_grow(spark):
    links = spark.createDataFrame([(p, e) for e in range(40) for p in range(e, e + 8)], "id int, pep int")
    few, many = proteins.pair_relations(links, links), proteins.pair_relations(links, links, each=20)
    assert rows(few) == rows(many) and many.rdd.getNumPartitions() >= 40 * 28 // 20


def test_run_metadata_is_not_joined_by_a_shuffle(spark):
    """All rows of a run would come to one task."""
    from massloom.sources.columns import add_run_metadata

    df, runs = spark.range(10).selectExpr("id", "string(id % 2) as rawfile"), spark.createDataFrame([("0", 1), ("1", 1)], "rawfile string, run int")
    out = add_run_metadata(df, runs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and {r["run"] for r in out.collect()} == {1}


def test_components_are_folded_many_to_a_task(spark):
    """A group of the query engine for each component took milliseconds of a task."""
    df = spark.createDataFrame([(k, k // 2, False, k // 2, 0, 1) for k in range(400)], "id long, component long, kept boolean, rowix_a long, pgrank_a long, acrank_a long")
    out = proteins._absorbed(df, ["a"])
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert rows(out) == sorted([(2 * k, k, 0, 1) for k in range(200)], key=str)
