"""The shared folder: taken from spark.checkpoint.dir, else below the warehouse."""

from lexitally.session import ensure_utc, scratch_path, shared_dir


def test_uses_configured_checkpoint_dir(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured and shared_dir(spark) == configured.rstrip("/")


def test_scratch_paths_are_fresh_and_under_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark) + "/x/")


def test_utc_pinned(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    ensure_utc(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
