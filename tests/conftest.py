import os

import pytest

from trailmark.operators import cleaning, kpi
from trailmark.session import get_session

RAW = "user_id long, item_id long, category_id long, behavior_type string, timestamp long"

# FIXTURES.md section 3: user, item, category, behaviour, unix seconds
TINY = [
    (1, 11, 1, "pv", 1704099600),
    (1, 11, 1, "buy", 1704103200),
    (1, 12, 1, "pv", 1704200400),
    (1, 12, 1, "buy", 1704409200),
    (2, 11, 1, "pv", 1704099600),
    (2, 11, 1, "cart", 1704110400),
    (2, 11, 1, "buy", 1704164400),
    (3, 12, 1, "pv", 1704225600),
    (3, 12, 1, "fav", 1704229200),
    (4, 13, 2, "cart", 1704207600),
    (3, 12, 1, "pv", 1704614400),
    (1, 11, 1, "pv", 1704099600),
    (2, 11, 1, "click", 1704110400),
    (3, 12, 1, "pv", 1706659200),
    (None, 12, 1, "pv", 1704157200),
]
# the window of the tiny frame, 2024-01-01 .. 2024-01-07 UTC
WINDOW = (1704067200, 1704671999)


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=os.environ.get("TEST_CPUS", "8"))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def raw(spark):
    return spark.createDataFrame(TINY, RAW)


@pytest.fixture(scope="session")
def ub(raw):
    return cleaning.time_features(cleaning.clean_events(raw, *WINDOW)).cache()


@pytest.fixture(scope="session")
def ud(ub):
    return kpi.int_user_daily_metrics(ub).cache()


def rows(df, *order):
    """Rows as tuples, ordered."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r)) if not order else out
