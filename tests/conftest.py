from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from requestmarts.session import local_session  # noqa: E402

TEST_DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(TEST_DATA / "sf0.01")
