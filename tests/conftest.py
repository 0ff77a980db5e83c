"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from grainmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A local session with its own warehouse."""
    found = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
