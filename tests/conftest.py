import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from framestride.session import CHUNK_ROWS, HOT_ROWS, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Force every series and every hot group to be split."""
    spark.conf.set(CHUNK_ROWS, "5")
    spark.conf.set(HOT_ROWS, "7")
    yield spark
    spark.conf.unset(CHUNK_ROWS)
    spark.conf.unset(HOT_ROWS)
