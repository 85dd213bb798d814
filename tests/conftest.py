from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomgraph.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", partitions=4, memory="6g")
    yield s
    s.stop()
