import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cardlens.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    yield s
