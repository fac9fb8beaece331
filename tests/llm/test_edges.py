"""Every operator and pipeline stage on messy and on empty tables."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from massloom.llm import chat_format, embedding_dedup, exact_dedup, licenses, line_dedup, mixing, packing, quality, sharding, simhash, simhash_jaccard


def rows_of(df):
    return df.collect()


OPERATORS = {
    "line": lambda d: line_dedup.line_dedup(d), "license": lambda d: licenses.license_scan(d), "shard": lambda d: sharding.sharding(d), "simhash": lambda d: simhash.simhash_dedup(d),
    "mix": lambda d: mixing.mix(d), "exact": lambda d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(messy, nothing, name):
    f = OPERATORS[name]
    got = rows_of(f(messy))
    assert len(got) == messy.count()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in messy.select("doc_id").collect())
    assert rows_of(f(nothing)) == []


def test_sharding_spreads_a_hot_id(spark, tmp_path):
    """A third of the rows without an id, and rows that repeat, go to one shard but to all of its buckets."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("one text").alias("text")).repartition(4)
    written = sharding.write_shards(df, f"file://{tmp_path}/hot", bucket_bytes=1000)
    hot = written.where("doc_doc_id is null").groupBy("shard", "bucket").count().collect()
    assert len({r["shard"] for r in hot}) == 1 and sum(r["count"] for r in hot) == 1000 and max(r["count"] for r in hot) < 300
    slots = sharding.slots(written).where(F.col("shard") == hot[0]["shard"])
    assert sorted(r["slot"] for r in slots.collect()) == list(range(slots.count()))


def test_packing_edges(messy, nothing):
    got = rows_of(packing.packed(messy))
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 1 and sum(r["length"] for r in got if r["doc_id"] == 4) == 1
    assert rows_of(packing.packed(nothing)) == []


def test_exact_dedup_defined_cases(messy):
    rows = rows_of(exact_dedup.exact_dedup(messy))
    got = {(r["doc_id"], r["keep_id"]): r for r in rows if r["doc_id"] is not None}
    assert {k for k in got if k[0] in (4, 5, 6)} == {(4, 6), (5, 6), (6, 6)}  # all empty; the longest original stays
    assert (1, 3) in got and (2, 2) in got
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 9) == [False, True, True]  # of two rows alike one stays
    kept = exact_dedup.kept_documents(messy)
    assert kept.columns == messy.columns
    texts = [r["text"] for r in rows_of(kept)]
    assert texts.count("same same") == 1 and len(texts) == 13 and all(r["_own"] == "x" for r in rows_of(kept))


def test_exact_dedup_across_batches(spark):
    from massloom.session import fresh_path

    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 4)
    a = spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "xy"), (4, "new"), (5, "new ")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows_of(exact_dedup.kept_documents(a, index))) == [1, 2]
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows_of(exact_dedup.exact_dedup(b, again))}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert rows_of(exact_dedup.kept_documents(b, again)) == []
    assert again.table().count() == 3


def test_exact_dedup_of_repeated_ids(spark):
    """Rows of one id: the longer original stays, and one of rows that repeat."""
    rows = [(1, "a b c"), (1, "abc"), (2, "x"), (2, "x"), (None, "x"), (3, " abc "), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for batches in (1, 2, 5):
        got = rows_of(exact_dedup.exact_dedup(df, batches=batches))
        assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(0, 2, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 3, False), (2, 2, 3, True), (3, 1, 3, False), (3, 3, 1, True)]
        assert sorted((r["doc_id"], r["text"]) for r in rows_of(exact_dedup.kept_documents(df, batches=batches))) == [(1, "a b c"), (2, "x"), (3, "q")]


def test_exact_dedup_runs_again(spark):
    """A job that died after its append gives the same rows when it runs again under its name; others get none of them."""
    from massloom.session import fresh_path

    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 4)
    df = spark.createDataFrame([(k, f"t{k % 7} {k % 3}") for k in range(40)], "doc_id long, text string")
    first = sorted(r["doc_id"] for r in rows_of(exact_dedup.kept_documents(df, index, batch="monday")))
    n = index.table().count()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert sorted(r["doc_id"] for r in rows_of(exact_dedup.kept_documents(df, again, batch="monday"))) == first and again.table().count() == n == len(first)
    assert {r["kept"] for r in rows_of(exact_dedup.exact_dedup(df, again, batch="monday"))} == {True, False}
    again.compact()
    assert again.generation == 1 and again.table().count() == n
    later = exact_dedup.DigestIndex(spark, index.path)
    assert (later.generation, later.buckets) == (1, 4) and rows_of(exact_dedup.kept_documents(df, later, batch="tuesday")) == []
    plan = df.sparkSession.table(later.name).hint("merge").join(df.select(exact_dedup.text_digest(F.col("text")).alias("digest")).hint("merge"), "digest", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the index side needs none


def test_simhash_one_of_each(messy, nothing):
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    got = [(r["doc_id"], r["text"]) for r in rows_of(kept)]
    assert len(got) == len(set(got))
    assert sum(not (t or "").strip() for _, t in got) == 1  # null, empty and blank texts share fingerprint zero
    assert [t for _, t in got].count("same same") == 1 and rows_of(simhash.one_of_each(nothing)) == []


def test_mixing_repeats(messy, nothing):
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in rows_of(mixing.mix(messy))}
    out = rows_of(mixing.mixed_documents(messy))
    for (i, size), k in taken.items():
        if i is not None and i != 9:
            assert sum(r["doc_id"] == i and len((r["text"] or "").split()) == size for r in out) == k
    assert mixing.mixed_documents(messy).columns == messy.columns and rows_of(mixing.mixed_documents(nothing)) == []


def test_quality_edges(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scorer = quality.train(messy, labels)
    got = rows_of(quality.score(messy, scorer))
    assert len(got) == messy.count() and all(r["kept"] and r["quality_score"] == 1.0 for r in got)  # one class: all stay
    assert quality.good_documents(messy, quality.classified(messy, labels)).count() == messy.count()
    assert rows_of(quality.score(nothing, quality.train(nothing, labels))) == [] and quality.good_documents(nothing, quality.classified(nothing, labels)).count() == 0
    many = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("Plain words make a fair sentence here.")).otherwise(F.lit("BUY!! NOW!! CHEAP!! $$$ ###")).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    for n in (2, 3, 60):  # few labels too
        known = many.where(F.col("doc_id") < n).select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
        assert len(rows_of(quality.score(messy, quality.train(many, known)))) == messy.count()
        kept = quality.good_documents(many, quality.classified(many, known))
        assert kept.columns == many.columns and {r["doc_id"] % 2 for r in rows_of(kept)} == {0}


def test_embedding_edges(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v, 0), (2, [2.0, 0.0, 0.0], 0), (3, [0.99, 0.05, 0.0], 0), (4, v, 1), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [math.nan, 1.0, 0.0], 0), (8, v, None), (9, [], 0), (10, [1.0, None, 0.0], 0), (11, v, 0), (11, v, 0), (None, v, 0), (12, [math.inf, 0.0, 0.0], 0), (13, [1.0, 0.0], 0), (14, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in rows_of(embedding_dedup.embedding_dedup(df)))
    assert got == sorted([(0, 0, None), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 4, 1), (11, 4, 1), (12, 0, 12), (13, 0, 13), (14, 0, 14)])
    assert rows_of(embedding_dedup.embedding_dedup(df.limit(0))) == []


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "assistant", "### a </turn> \\\\### \\"), (2, 0, "assistant", "### a </turn> \\\\### \\"), (None, 1, "user", ""), (3, None, "###", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in rows_of(chat_format.digest_of(chat_format.format_conversations(df)))}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 2, None: 1, 3: 1}
    assert got[1]["loss_chars"] == 0 and got[2]["loss_chars"] == 2 * len(rows[3][3])
    assert rows_of(chat_format.digest_of(chat_format.format_conversations(df.limit(0)))) == []


def test_stages_on_messy_and_empty(spark, messy, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (messy, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert k == 4 or out.columns == messy.columns
            assert docs is messy or n == 0


def test_tables_too_large_to_broadcast(spark, messy, monkeypatch):
    """What is joined by a shuffle, where a counted table is over the bound, gives the same rows."""
    stages = [lambda: exact_dedup.kept_documents(messy), lambda: simhash_jaccard.one_of_each(messy), lambda: packing.packed(messy).select("doc_id", "length")]
    first = [sorted(map(str, f().collect())) for f in stages]
    for module in (exact_dedup, simhash_jaccard, simhash, packing, quality):
        monkeypatch.setattr(module, "few", lambda df, rows=0: df)
    assert [sorted(map(str, f().collect())) for f in stages] == first


def test_embedding_norms_of_any_size(spark):
    """Vectors of tiny and huge components link by their cosine, and change no other vector's links."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    planted = [(3 * k + j, [float(c) for c in base[k] + rng.normal(size=16) * 0.01], "x") for k in range(60) for j in range(3)]
    small = [(1000, [1e-200 * c for c in planted[0][1]], "x"), (1001, [1e200 * c for c in planted[3][1]], "x"), (1002, [5e-324] + [0.0] * 15, "x"), (1003, [1e308] + [0.0] * 15, "x"), (1004, [0.0] * 16, "x")]
    schema = "vec_id long, embedding array<double>, label string"
    links = lambda rows: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, schema)).collect()}
    before, after = links(planted), links(planted + small)
    assert sum(n for n, _ in before.values()) == 360
    for i, (n, c) in before.items():
        assert after[i] == (n + (i // 3 in (0, 1)), c)
    assert after[1000] == (3, 0) and after[1001] == (3, 3) and after[1002] == (1, 1002) and after[1003] == (1, 1002) and after[1004] == (0, 1004)


def test_embedding_extra_columns(spark):
    rows = [(k, [1.0, 0.01 * k], "l", "x", 7, [2.0], "r") for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep string, copies int, v array<double>, h1 string")
    assert sorted(tuple(r) for r in rows_of(embedding_dedup.embedding_dedup(df))) == [(k, 3, 0, k == 0) for k in range(4)]


def test_quality_repeated_labelled_id(spark, monkeypatch):
    """A labelled document that repeats thousands of times sends one row to the driver and is one example."""
    import pandas as pd

    rows = [(k, ("good words of prose here " if k % 2 else "buy now $$ click ") * (3 + k % 5), "en", "s", 10) for k in range(80)]
    docs = spark.createDataFrame(rows + [rows[3]] * 3000, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    table = quality.materialize(quality.features(docs), "features")
    sizes = []
    plain = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda df: sizes.append(got := plain(df)) or got)
    scorer = quality.train_on(table, labels)
    assert max(len(x) for x in sizes if isinstance(x, pd.DataFrame) and "t" in x.columns and "y" in x.columns) == 60
    monkeypatch.undo()
    once = quality.train_on(quality.materialize(quality.features(docs.dropDuplicates()), "features"), labels)
    score = lambda s: {r["doc_id"]: round(r["quality_score"], 6) for r in quality.score_features(table, s).collect()}
    assert set(score(scorer)) == set(score(once))
