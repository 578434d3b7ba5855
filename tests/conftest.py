import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from creditloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(schema, *rows) → DataFrame; ISO text becomes dates where the schema says date."""
    import datetime as dt

    def build(schema: str, *rows):
        kinds = [part.strip().split(" ", 1)[1] for part in schema.split(",")]
        cells = [
            tuple(
                dt.date.fromisoformat(v) if k == "date" and isinstance(v, str) else v
                for v, k in zip(row, kinds)
            )
            for row in rows
        ]
        return spark.createDataFrame(cells, schema)

    return build


def tidy(tuples):
    """One fixed order for tuples that may hold NULLs."""
    return sorted(map(tuple, tuples), key=lambda t: tuple(map(str, t)))


def rows(df, *names):
    """Collected rows in that order."""
    return tidy((df.select(*names) if names else df).collect())
