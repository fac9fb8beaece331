import pytest

from massloom import session


def test_tables_in_the_shared_folder(spark):
    df = session.materialize(spark.range(5).selectExpr("id", "id * 2 as x"), "t")
    assert df.count() == 5 and session.shared_dir(spark).startswith("file:") and all(f.startswith(session.shared_dir(spark)) for f in df.inputFiles())
    session.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(f"{session.shared_dir(spark)}/massloom").count()


def test_scratch_of_a_block(spark):
    """What a block writes goes with it, what was named before stays."""
    from massloom.session import fresh_path, materialize, scratch, scratch_dir

    stays = fresh_path(spark, "stays")
    with scratch(spark):
        inner = materialize(spark.range(3), "inner")
        inner.write.parquet(stays)
        assert "/scope-" in inner.inputFiles()[0]
    assert spark.read.parquet(stays).count() == 3 and spark.sparkContext.applicationId in scratch_dir(spark)
    with pytest.raises(Exception, match="(?i)not_exist|not exist|not found|no such"):
        inner.collect()
