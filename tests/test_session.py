import os
import subprocess
import sys
from pathlib import Path

import pytest

from tessella import session
from tessella.session import discard, durable, keep, scratch, shared_dir

ROOT = str(Path(__file__).resolve().parent.parent)


def names(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


def test_scopes_remove_what_they_wrote(spark):
    before = names(spark)
    with scratch():
        outer = durable(spark.range(3).toDF("i"))
        with scratch():
            durable(spark.range(2).toDF("i"))
            kept = keep(durable(spark.range(4).toDF("i")))
        assert kept.count() == 4 and outer.count() == 3 and len(names(spark) - before) == 2
        discard(outer)
        assert len(names(spark) - before) == 1
    assert names(spark) == before


def test_a_scope_is_left_by_an_error(spark):
    before = names(spark)
    with pytest.raises(KeyError), scratch():
        durable(spark.range(3).toDF("i"))
        raise KeyError
    assert names(spark) == before


FALLBACK = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
# A session of the caller's own, without a checkpoint folder, started away from the package.
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
from tessella.session import shared_dir
rows = entry.queries()["{name}"](spark, "/root/testdata/sf0.001").count()
print("ROWS", rows, shared_dir(spark) == shared_dir(spark), shared_dir(spark).startswith("file:///tmp/"))
"""


@pytest.mark.parametrize("name", ["sync_report", "feature_hash_embed"])
def test_without_a_checkpoint_folder_and_away_from_the_package(tmp_path, name):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    done = subprocess.run([sys.executable, "-c", FALLBACK.format(root=ROOT, name=name)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    out = [line for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert out and out[0].split()[2:] == ["True", "True"] and int(out[0].split()[1]) > 0, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
