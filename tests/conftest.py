import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from rateflow.session import local_session

    s = local_session("*", app="rateflow-tests")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def _nothing_cached(spark):
    """What the tests of one file cache is gone before the next."""
    yield
    spark.catalog.clearCache()


@pytest.fixture
def extract(spark):
    """Run the html pipeline on a list of html strings; returns (detected, rate_rows) as lists."""
    from rateflow.plans import pipeline

    def run(htmls, strict=False):
        df = spark.createDataFrame(list(enumerate(htmls)), "message_id BIGINT, html STRING")
        detected = pipeline.detect_rate_tables(df, strict=strict)
        rows = pipeline.rate_rows_from_detected(detected)
        return (
            sorted(detected.collect(), key=lambda r: r["message_id"]),
            sorted(rows.collect(), key=lambda r: (r["message_id"], r["table_idx"], r["row_idx"])),
        )

    return run
