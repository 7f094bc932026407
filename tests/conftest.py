import datetime as dt

import pytest

from inplay.session import local_session

UTC = dt.timezone.utc
T0 = dt.datetime(2025, 9, 7, 17, 0, tzinfo=UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=float(seconds))


def since(ts):
    """Seconds after T0 of a collected timestamp (the session runs in UTC)."""
    return None if ts is None else (ts.replace(tzinfo=UTC) - T0).total_seconds()


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=8, shuffle_partitions=4)


@pytest.fixture
def sliced(spark):
    """Make entities of more than five rows hot."""
    spark.conf.set("spark.inplay.sliceRows", "5")
    yield spark
    spark.conf.unset("spark.inplay.sliceRows")
