import os
import tempfile

import pytest
from pyspark.sql import SparkSession

TESTDATA = os.environ.get("SITESPEC_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("sitespec-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sitespec-checkpoint-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def evaluate(spark):
    """Run one column function over many argument tuples as a single job."""

    def run(fn, rows, types):
        fields = ", ".join(f"a{i} {t}" for i, t in enumerate(types))
        df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], f"n int, {fields}")
        out = df.select("n", fn(*[df[f"a{i}"] for i in range(len(types))]).alias("out"))
        return [r["out"] for r in sorted(out.collect(), key=lambda r: r["n"])]

    return run
