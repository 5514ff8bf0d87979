import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from histshift.config import RunConfig  # noqa: E402
from histshift.sources.schemas import pings_schema  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
PROBES = ("h1", "h2")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("histshift-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture
def cfg():
    return RunConfig(probes=PROBES, final_date=dt.date(2024, 1, 15), num_days=7, num_reps=20,
                     app="app", channel="nightly", sample="numeric")


def make_pings(spark, rows, probes=PROBES):
    """rows: (client, build_id, {probe: map or None}) with app 'app', channel nightly, sample '1'."""
    data = [(c, b, "app", "nightly", "1", *[hists.get(p) for p in probes]) for c, b, hists in rows]
    return spark.createDataFrame(data, pings_schema(probes))
