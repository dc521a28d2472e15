from pathlib import Path

import pytest


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry_and_worker_path(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.HERE in spark.sparkContext.environment["PYTHONPATH"]
    assert set(e.oracle_sql()) <= set(e.queries())
