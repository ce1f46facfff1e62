import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from docproof.session import builder, tune


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("docproof-tests").master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docproof-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of a column expression over a list of rows: apply(fn, [row, ...], "a string, ...")."""
    def run(fn, rows, schema="a string"):
        from pyspark.sql import functions as F
        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, "i int, " + schema)
        columns = [F.col(c) for c in df.columns[1:]]
        return [r.v for r in df.select("i", fn(*columns).alias("v")).orderBy("i").collect()]
    return run
