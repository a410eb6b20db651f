import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plaudit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="6g",
                            spark__checkpoint__dir=tmp_path_factory.mktemp("shared").as_uri())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows_of():
    """Rows of a frame as sorted tuples."""
    def collected(frame, *columns):
        return sorted((tuple(row) for row in (frame.select(*columns) if columns else frame).collect()),
                      key=lambda row: tuple((value is not None, value) for value in row))
    return collected
