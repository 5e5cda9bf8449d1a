from webloom.session import checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    got = checkpoint_dir(spark)
    # The configured shared folder is used (Spark adds a per-application sub-folder).
    assert configured.rstrip("/").split("/")[-1] in got
    assert checkpoint_dir(spark) == got            # stable, never re-created


def test_checkpoint_cuts_lineage(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").checkpoint(eager=True)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "Range" not in plan                      # reads the checkpoint, not the source plan
    assert df.count() == 1000 and df.groupBy("k").count().count() == 7


def test_no_local_checkpoint_folder_on_a_cluster():
    import pytest

    class _Conf:
        def get(self, key, default=None):
            return default

    class _SC:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return _Conf()

    class _Session:
        sparkContext = _SC()
        conf = _Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session())
