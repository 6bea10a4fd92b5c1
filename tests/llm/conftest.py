import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from penmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield local_session(8, shuffle_partitions=8, app="penmark-llm-tests")


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with expected dicts, in any order."""

    def key(row):
        return tuple((v is None, str(v)) for _, v in sorted(row.items()))

    def check(df, expected):
        got = sorted((r.asDict(recursive=True) for r in df.collect()), key=key)
        assert got == sorted(expected, key=key)

    return check
