import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm import AWKWARD, table


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, AWKWARD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, []).cache()


@pytest.fixture(scope="session")
def made(spark):
    return lambda rows: table(spark, rows)
