import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from emberlake.session import local_session

    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture
def raw(spark):
    """Payload rows of a landing zone."""

    def make(*payloads, url="https://example.org/feed"):
        rows = [(url, p) for p in payloads]
        return spark.createDataFrame(rows, "url string, payload string").selectExpr("*", "timestamp'2026-07-28 00:00:00' AS fetched_at")

    return make
