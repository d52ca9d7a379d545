import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sidelines import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sidelines-test-ckpt-")})
    yield s


@pytest.fixture
def rows():
    def _rows(df, *cols):
        cols = cols or df.columns
        return [tuple(r[c] for c in cols) for r in df.collect()]
    return _rows
