"""Fixtures of the test kit, for all tests."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewright.testing import clear_env, df_builder, spark_session, spark_session_function, temp_table  # noqa: E402, F401

import pytest  # noqa: E402


@pytest.fixture
def spark(spark_session):  # noqa: ANN001, ANN201, F811
    return spark_session
