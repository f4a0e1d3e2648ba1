import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veilspark.session import local_session

    s = local_session(4, memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture
def rows():
    """A DataFrame's rows as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
