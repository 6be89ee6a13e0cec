from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session(4, 4, "3g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
