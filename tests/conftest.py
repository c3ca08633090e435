import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oddslake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    yield session
    session.stop()


@pytest.fixture
def candidates(spark):
    """Candidate rows from (market, event, observed_at) tuples of Python dicts."""

    def build(*items):
        rows = []
        for pos, (market, event, observed_at) in enumerate(items):
            rows.append((json.dumps(market), None if event is None else json.dumps(event), observed_at, pos))
        return spark.createDataFrame(rows, "market STRING, event STRING, observed_at STRING, row_pos BIGINT")

    return build
