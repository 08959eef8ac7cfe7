import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerline.session import build_session
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(master="local[4]", shuffle_partitions=8, extra={
        "spark.driver.memory": "8g", "spark.checkpoint.dir": str(folder / "shared"),
        "spark.ledgerline.tables.dir": str(folder / "tables"), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def model_small(spark):
    from ledgerline.sources.standin import standin_model
    return standin_model(spark, SF_SMALL)


@pytest.fixture(scope="session")
def model_check(spark):
    from ledgerline.sources.standin import standin_model
    return standin_model(spark, SF_CHECK)
