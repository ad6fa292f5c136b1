"""Session settings, shared folder, freshness of stored tables."""

import os
import time

import pytest

from staylens import session
from staylens.plans import stages


def test_submitted_settings_stay(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        again = session.get_session()
        assert again.conf.get("spark.sql.session.timeZone") == "America/New_York"
        assert again.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_a_local_folder_is_only_for_local_masters():
    assert session._is_local("local[4]") and not session._is_local("local-cluster[3,2,1024]") and not session._is_local("spark://h:7077")

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_a_changed_source_is_read_anew(spark, scratch_dir):
    path = os.path.join(scratch_dir, "t")
    read = lambda: stages.materialised(spark, f"{path}|{stages.source_mark(spark, [path])}", lambda: spark.read.parquet(path)).count()
    spark.range(3).write.parquet(path)
    assert read() == 3
    time.sleep(0.01)
    spark.range(4).write.mode("append").parquet(path)
    assert read() == 7
    assert stages.source_mark(spark, [path + "-none"])
