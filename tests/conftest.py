import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


def rows(df, *columns):
    """Rows as sorted tuples of the named columns."""
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


LISTING_ROWS = [
    (1, 0, 71.5, 80.25, 11, 1, 133, "csv"),
    (2, 1, 19.0, 16.5, 4, 0, 77, "csv"),
    (3, 0, 33.0, 33.0, 6, 1, 310, "csv"),
]


@pytest.fixture
def listings(spark):
    from demandloom.schemas import LISTING

    return spark.createDataFrame(LISTING_ROWS, LISTING)


@pytest.fixture
def bookings(spark):
    keys = [2, 1, 2, 3, 2, 2, 1]
    return spark.createDataFrame(
        [(k, "2023-07-09") for k in keys], "vehicle_id long, created_at string"
    ).selectExpr("vehicle_id", "cast(created_at as timestamp) as created_at")
