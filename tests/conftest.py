import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tests.session import spark_session

    session = spark_session(**{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Force the block paths: no task may order more than 16 rows of one key."""
    spark.conf.set("spark.tidemark.blockRows", "16")
    yield spark
    spark.conf.unset("spark.tidemark.blockRows")
