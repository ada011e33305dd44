import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wattspark.session import get_session
    scratch = tempfile.mkdtemp(prefix="wattspark-tests-")
    s = get_session("local[4]", 4, app="wattspark-tests",
                    extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
                           "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="wattspark-t-")


def readings_df(spark, rows):
    """rows: (reading_id, household_id, 'YYYY-MM-DD HH:MM', kwh, stage, backup)"""
    import datetime as dt
    from wattspark.sources.readings import readings_from
    data = [(rid, h, dt.datetime.strptime(ts, "%Y-%m-%d %H:%M"), float(k), int(s), bool(b))
            for rid, h, ts, k, s, b in rows]
    df = spark.createDataFrame(data, "reading_id long, household_id string, timestamp timestamp_ntz, "
                                     "energy_consumption double, load_shedding_stage int, backup_power boolean")
    return readings_from(df)
