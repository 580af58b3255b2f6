"""Every registered query of the repository binding against its SQL in DuckDB, and the entry point."""

import duckdb
import pandas as pd
import pytest

from loomstone import queries, queries_history  # noqa: F401
from loomstone.plans.binding import TABLES
from loomstone.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def shown(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(shown(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        wanted = duck.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert normal(found) == normal(wanted)
    else:
        assert len(found) > 0


def test_mirror_of_blobs_that_only_links_name(spark, tmp_path):
    """Commit 4605 names blob b105 as its tree, which no commit's id makes an object of."""
    events = pd.DataFrame({"event_id": [10, 4605, 4606], "user_id": [5, 5, 12], "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"]), "event_type": ["view", "view", "view"]})
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = own.sql(ORACLES["mirror_objects"]).df()
    assert "c4605" in set(wanted["id"]) and "b105" not in set(wanted["id"])
    assert normal(QUERIES["mirror_objects"](spark, str(tmp_path)).toPandas()) == normal(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
