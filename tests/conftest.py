import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as E
    from ragtab.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="ragtab-tests")
    E._session_ready(s)
    yield s
