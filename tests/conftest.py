import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from attrition.session import local_session

    import tempfile

    scratch = tempfile.mkdtemp(prefix="attrition-tests-")
    s = local_session(cores="*", shuffle_partitions=8, app="attrition-tests", driver_memory="8g",
                      extra={"spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from attrition.sources.tables import TABLE_NAMES

    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
