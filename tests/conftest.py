import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandloom.session import local_session

    session = local_session(8, 4, "4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()
