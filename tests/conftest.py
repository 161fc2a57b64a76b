import sys
from pathlib import Path

import pytest
from paths import SF_DIR

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidemill.sources.bindings import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF_DIR)


@pytest.fixture
def rows():
    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))

    return collect
