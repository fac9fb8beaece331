"""Readers of text formats and wide reports on small files."""

import gzip

import pytest

from massloom.sources import columns, texts, wide
from massloom.sources.catalogues import DIA, SITE_FILES
from massloom.streaming.projections import run_projection


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "u.fasta", ">sp|P1|AA_HUMAN Some protein OS=Homo sapiens OX=9606 GN=AA PE=1 SV=2\nMKT\nAYI\n>odd header\nAAA\n>tr|Q2|B_X Other OS=Mus\nCC\n")
    got = {r["fasta_header"][:6]: r for r in texts.read_uniprot(spark, p).collect()}
    assert got["sp|P1|"]["protein_ac"] == "P1" and got["sp|P1|"]["genename"] == "AA" and got["sp|P1|"]["protein_existence"] == 1 and got["sp|P1|"]["seq"] == "MKTAYI"
    assert got["odd he"]["protein_ac"] is None and got["odd he"]["seq"] == "AAA" and got["tr|Q2|"]["genename"] is None and got["tr|Q2|"]["organism"] == "Mus"
    e = put(tmp_path / "e.fasta", ">ENSP0001.2 pep:known chromosome:G:1:2 gene:ENSG1 transcript:ENST1 gene_biotype:pc transcript_biotype:pc\nMM\n")
    r = texts.read_ensembl(spark, e).first()
    assert (r["protein_ac"], r["status"], r["gene_ac"], r["transcript_biotypes"]) == ("ENSP0001", "known", "ENSG1", "pc")
    assert texts.read_ensembl(spark, put(tmp_path / "s.fasta", ">ENSP1 A5T;K9R\nM\n"), False, True).first()["SAAVs"] == "A5T;K9R"
    with pytest.raises(ValueError):
        texts.read_ensembl(spark, e, True, True)
    c = put(tmp_path / "c.fasta", ">CON__P9 SWISS-PROT:P9|Tax (Bos taurus) albumin\nM\n>CON__TREMBL:Q5 (Homo) keratin\nK\n>zzz\nA\n")
    got = texts.read_contaminants(spark, c).collect()
    assert {(r["protein_ac"], r["src_db"]) for r in got} == {("CON__P9", "SWISS-PROT"), ("Q5", "TREMBL"), (None, None)}
    f = put(tmp_path / "p.fasta", ">GN:AKT1|Akt|human|P31749\nMSD\n>GN:-|x|human|P2\nM\n")
    assert {(r["genename"], r["protein_ac"]) for r in texts.read_site_fasta(spark, f).collect()} == {("AKT1", "P31749"), (None, "P2")}


def test_gmt(spark, tmp_path):
    p = put(tmp_path / "a.gmt", "n1%GOBP%GO:1\td1\ta\tb\tb\nn2%REACTOME%123\td2\tx\nn1b%GOBP%GO:1\td3\tc\n")
    info, members = texts.read_gmt(spark, p)
    assert info.count() == 3 and {tuple(r) for r in members.collect()} == {("GO:1", "c"), ("R-HSA-123", "x")}
    assert {r["src"] for r in info.collect()} == {"GO_BP", "Reactome"}
    with pytest.raises(Exception, match="not name%source%id"):
        texts.read_gmt(spark, put(tmp_path / "b.gmt", "plain\td\ta\n"))[0].collect()
    assert texts.read_gmt(spark, put(tmp_path / "c.gmt", "n%S%7\td\t1\t2\n"), obj_type="long")[1].count() == 2


def test_gtf(spark, tmp_path):
    p = put(tmp_path / "a.gtf", '#!genome\n1\tens\tgene\t10\t20\t.\t+\t.\tgene_id "G1"; tag "a"; tag "b"\n1\tens\texon\t10\t12\t.\t+\t.\tgene_id "G1"; bad\n')
    df = texts.read_gtf(spark, p)
    got = texts.parse_attributes(df).orderBy("feature").collect()
    assert [(r["start"], r["gene_id"], r["tag"]) for r in got] == [(10, "G1", None), (10, "G1", "b")]
    assert texts.read_gtf(spark, p, 1).count() == 1


def test_sites(spark, tmp_path):
    for name, file in SITE_FILES.items():
        head = "SUB_ACC_ID\tSUB_MOD_RSD\tGENE\tKINASE" if name == "KinaseSubstrate" else "ACC_ID\tMOD_RSD\tGENE\tORGANISM"
        body = "P1\tS5\tK\tAKT" if name == "KinaseSubstrate" else "P1\tS5-p\tG\thuman"
        with gzip.open(tmp_path / f"{file}.gz", "wt") as f:
            f.write(f"date\nlicence\n\n{head}\n{body}\n")
    got = texts.read_site_annotations(spark, str(tmp_path), gz=True)
    r, k = got["PhosphoSites"].first(), got["KinaseSubstrate"].first()
    assert (r["protein_ac"], r["ptm_AA"], r["ptm_pos"], r["ptm_code"], r["gene_name"]) == ("P1", "S", 5, "p", "G")
    assert (k["protein_ac"], k["ptm_pos"], k["kinase_gene_name"], k["kinase_protein_name"]) == ("P1", 5, "K", "AKT") and "ptm_code" not in k


def test_motifs_and_network(spark, tmp_path):
    put(tmp_path / "m" / "a.msa", ">PROT|P1/5-20: ZINC|PS1/3.7\nAC-D\n>PROT|P2/1-4: ZINC|PS2\nAC\n")
    got = {r["protein_ac"]: r for r in texts.read_motif_alignments(spark, str(tmp_path / "m")).collect()}
    assert got["P1"]["protein_range"]["end"] == 20 and got["P1"]["motif_range"]["start"] == 3 and got["P1"]["motif_id"] == "PS1" and got["P2"]["motif_range"] is None
    put(tmp_path / "bad" / "a.msa", ">nope\nA\n")
    with pytest.raises(Exception, match="unexpected motif header"):
        texts.read_motif_alignments(spark, str(tmp_path / "bad")).collect()
    fi = put(tmp_path / "fi.txt", "Gene1\tGene2\tDirection\tScore\nA\tB\t->\t0.5\nC\tD\t<->\t1\n")
    di = put(tmp_path / "di.txt", "direction\tsource\ttarget\tsrc_to_dest\tdest_to_src\n->\ts\tt\t1\t0\n<->\tu\tv\t1\t1\n")
    assert sorted((r["gene1"], r["gene2"], r["is_reverse"]) for r in texts.read_network(spark, fi, di).collect()) == [("A", "B", False), ("C", "D", False), ("D", "C", True)]


def test_set_collections(spark, tmp_path):
    spark.createDataFrame([("s", 1), ("s", 2)], "set_id string, obj_id long").write.parquet(f"{tmp_path}/c2")
    with pytest.warns(UserWarning):
        got = texts.read_set_collections(spark, {"c2": f"{tmp_path}/c2", "H": f"{tmp_path}/none"})
    assert {r["coll_id"] for r in got.collect()} == {"Hs_SigDB_c2"} and got.count() == 2


def test_reports(spark, tmp_path):
    put(tmp_path / "proteinGroups.txt", "id\tProtein IDs\tMol. weight [kDa]\tReverse\tPotential contaminant\tIntensity\tIntensity H run1\tRatio H/L type\tIdentification type run1\n1\tA;B\t5.5\t+\t\t10\t0\tx\tBy MS/MS\n2\tC\tNaN\t\t+\t0\t7\t\t\n")
    df, names = wide.read_protgroups(spark, str(tmp_path), ["intensity", "ident_type", "ratio"])
    a, b = df.orderBy("protgroup_id").collect()
    assert a["is_reverse"] is True and b["is_reverse"] is False and b["is_contaminant"] is True and a["mol_weight_kDa"] == 5.5 and b["mol_weight_kDa"] is None
    assert a["Intensity."] == 10.0 and b["Intensity."] is None and b["Intensity.run1|H"] == 7.0 and a["ident_type.run1"] == "By MS/MS" and b["ident_type.run1"] is None
    assert names["ratio"] == {"Ratio H/L type": "Ratio.H/L type"}
    with pytest.raises(ValueError):
        wide.read_wide_table(spark, str(tmp_path / "proteinGroups.txt"), DIA)
    with pytest.warns(UserWarning):
        wide.read_protgroups(spark, str(tmp_path), ["nonsense"])
    assert wide.read_protgroups(spark, str(tmp_path), [], limit=1)[0].count() == 1


def test_evidence(spark, tmp_path):
    put(tmp_path / "evidence.txt", "Raw file\tExperiment\tFraction\tid\tIntensity\tType\tPeptide ID\tSequence\tModified sequence\tCharge\tPhospho (STY) Probabilities\nf1\te\t1\t1\t5\tMSMS\t7\tAK\t_AK_\t2\tA(1)K\nf2\te\t2\t2\t\tMULTI-MATCH\t7\tAK\t_AK_\t3\t\n")
    runs = spark.createDataFrame([("f1", "E1", False), ("f2", "E2", True)], "rawfile string, msexperiment string, is_skipped boolean")
    df, _ = wide.read_evidence(spark, str(tmp_path), runs, ["peptide", "pepmodstate", "pepmod_ptms"])
    r = df.collect()
    assert len(r) == 1 and r[0]["msrun"] == "E1_F1" and r[0]["msexperiment_orig"] == "e" and r[0]["ident_type_code"] == 3 and r[0]["pepmodstate_id"] == 0 and r[0]["ptm_locprob_seq.Phospho"] == "A(1)K"
    assert wide.read_evidence(spark, str(tmp_path))[0].count() == 2
    with pytest.raises(ValueError, match="not unique"):
        columns.add_run_metadata(df, runs.union(runs))
    with pytest.raises(ValueError, match="no rawfile"):
        columns.add_run_metadata(df.drop("rawfile"), runs)


def test_dia(spark, tmp_path):
    p = put(tmp_path / "r.tsv", "PG.ProteinGroups\tPG.Genes\tEG.PrecursorId\tEG.IsDecoy\tR.FileName\t[1] a.raw.PG.Quantity\t[2] b.raw.PG.Quantity\nP1\tG\t_AK_.2\tFalse\tf\t5.5\tFiltered\n")
    df, _ = wide.read_dia_report(spark, p)
    r = df.first()
    assert r["protgroup_sn_id"] == "P1" and r["is_decoy"] is False and r["rawfile"] == "f" and r["PG_intensity.[1] a.raw"] == "5.5" and r["PG_intensity.[2] b.raw"] is None


def test_column_names(spark):
    got = columns.parse_msrun_columns(["Intensity.r1|H", "Intensity.", "iBAQ", "X.a.b"])
    assert [(g["measure"], g["msrun"], g["mstag"]) for g in got] == [("Intensity", "r1", "H"), ("Intensity", None, None), ("iBAQ", None, None), ("X", "a.b", None)]
    assert columns.parse_ratio_columns(["Ratio.H/L normalized s1"])[0] == {"colname": "Ratio.H/L normalized s1", "nom": "H", "denom": "L", "measure": "normalized", "sample": "s1"}
    assert columns.parse_metrics_columns(["PG_intensity.[2] a.raw"])[0]["rawfile_ix"] == 2
    with pytest.raises(ValueError):
        columns.parse_metrics_columns(["zzz"])
    assert columns.column_frame(spark, got).count() == 4


def test_projection_on_a_stream(spark, tmp_path):
    from massloom.functions.lists import expand_delim_column

    spark.createDataFrame([(1, "a;b"), (2, "c")], "k int, xs string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, xs string").parquet(f"{tmp_path}/in")
    run_projection(stream, lambda d: expand_delim_column(d, "xs", "k"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (1, "b"), (2, "c")]


def r_item(value, names=None):
    """R's serialisation of strings, numbers and lists."""
    import struct

    number = lambda *x: struct.pack(f">{len(x)}i", *x)
    chars = lambda x: number(9 | 1 << 18, len(x)) + x.encode()
    flags = 512 if names else 0
    if all(isinstance(v, str) for v in value):
        out = number(16 | flags, len(value)) + b"".join(map(chars, value))
    elif all(isinstance(v, int) for v in value):
        out = number(13 | flags, len(value)) + number(*value)
    else:
        out = number(19 | flags, len(value)) + b"".join(map(r_item, value))
    if names:
        out += number(2 | 1024) + number(1) + chars("names") + r_item(names) + number(254)
    return out


def test_saved_r_lists(spark, tmp_path):
    import struct

    from massloom.sources.rdata import read_rdata

    sets = r_item([["1", "2", "2"], ["3"]], ["SET_A", "SET_B"])
    body = b"RDX2\nX\n" + struct.pack(">3i", 2, 0x30000, 0x20300) + struct.pack(">2i", 2 | 1024, 1) + struct.pack(">2i", 9 | 1 << 18, 5) + b"Hs.c2" + sets + struct.pack(">i", 254)
    assert read_rdata(gzip.compress(body)) == {"Hs.c2": {"SET_A": ["1", "2", "2"], "SET_B": ["3"]}} == read_rdata(body)
    assert read_rdata(body.replace(b"RDX2", b"RDX3").replace(struct.pack(">3i", 2, 0x30000, 0x20300), struct.pack(">3i", 3, 0x30000, 0x20300) + struct.pack(">i", 5) + b"UTF-8"))["Hs.c2"]["SET_B"] == ["3"]
    with pytest.raises(ValueError, match="not a binary R workspace"):
        read_rdata(b"zzz")
    (tmp_path / "human_c2_v5p2.rdata").write_bytes(gzip.compress(body))
    with pytest.warns(UserWarning):
        got = texts.read_set_workspaces(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("Hs_SigDB_C2", "SET_A", 1), ("Hs_SigDB_C2", "SET_A", 2), ("Hs_SigDB_C2", "SET_B", 3)]


def test_names_as_rows(spark):
    """Names of columns that are rows have the fields that a list of names has."""
    names = ["Intensity.r1|H", "Intensity.", "iBAQ"]
    got = columns.parsed_names(spark.createDataFrame([(n,) for n in [*names, None]], "colname string"), columns.MSRUN).collect()
    assert [r.asDict() for r in got if r["colname"]] == columns.parse_msrun_columns(names) and got[-1]["measure"] is None
    got = columns.parsed_names(spark.createDataFrame([("PG_intensity.[2] a.raw",), ("x.[10] ",)], "colname string"), columns.METRICS).collect()
    assert [r.asDict() for r in got] == columns.parse_metrics_columns(["PG_intensity.[2] a.raw", "x.[10] "])
    with pytest.raises(Exception, match="cannot be parsed"):
        columns.parsed_names(spark.createDataFrame([("zzz",)], "colname string"), columns.METRICS).collect()
