import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from launch_data import LAUNCHES, SWAPS, raw_tables  # noqa: E402

from curvelens import Pipeline  # noqa: E402
from curvelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 4, "curvelens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def fixture_pipeline(spark):
    return Pipeline(raw_tables(spark, SWAPS, LAUNCHES))
