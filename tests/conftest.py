import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillvec.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one_row(spark):
    """Evaluate columns once: one_row(a=Column, ...) -> Row."""

    def evaluate(**columns):
        return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()

    return evaluate
