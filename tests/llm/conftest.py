import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("LEXITILE_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)
