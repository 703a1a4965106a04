import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def few_buckets():
    """Tables of a few rows need few folders."""
    from codeloom.operators import text_index, traverse, trigrams
    from codeloom.sources import catalog

    with pytest.MonkeyPatch.context() as patch:
        for owner, name in ((text_index, "BUCKETS"), (trigrams, "BUCKETS"), (traverse, "CALL_BUCKETS"), (catalog.Tables, "BUCKETS")):
            patch.setattr(owner, name, 3)
        yield
