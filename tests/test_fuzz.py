"""Random five-table datasets: every registered query equals its SQL statement.

The generated data breaks every convenient assumption except primary keys:
several transactions and reviews per ride (join fan-out), declined and
status-less charges, NULL users, drivers, ratings, amounts and timestamps,
rides by users missing from signups, signups without a download, reviews and
transactions of unknown rides, rides both dropped off and cancelled or
neither.  The SQL runs the plain joins; the Spark plans pre-aggregate, so
this checks that the rewrites keep the join semantics exactly."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from helpers import duck_rows, spark_rows
from ridelens.plans.exchange import exchange_queries
from ridelens.plans.oracle import core_sql, derived_sql
from ridelens.plans.panels import panel_queries
from ridelens.plans.registry import CORE_QUERIES
from ridelens.plans.store import SessionStore
from ridelens.plans.store_queries import store_queries
from ridelens.sources.schemas import AGE_RANGES, PLATFORMS, TABLE_SCHEMAS
from ridelens.sources.tables import RideTables

SEEDS = [1, 7, 42]
# inside the window of the window-filtered panel, so it returns rows
T0 = dt.datetime(1995, 3, 1)


def _maybe(rng, value, p_null):
    return None if rng.random() < p_null else value


def generate(seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(60)]
    downloads = [(k, rng.choice([*PLATFORMS, "tablet"]), T0 + dt.timedelta(days=rng.randrange(40))) for k in keys]
    sessions = rng.sample(keys, 40) + [f"missing-{i}" for i in range(5)]
    signups = [(uid, sessions[uid - 1], T0 + dt.timedelta(days=rng.randrange(40), hours=rng.randrange(24)),
                _maybe(rng, rng.choice(AGE_RANGES), 0.08)) for uid in range(1, 46)]
    rides, tx, reviews = [], [], []
    review_id = 5000
    for ride_id in range(1, 301):
        user = _maybe(rng, rng.randrange(1, 51), 0.04)
        start = _maybe(rng, T0 + dt.timedelta(days=rng.randrange(60), hours=rng.randrange(24)), 0.04)
        state = rng.random()
        base = start or T0
        dropoff = base + dt.timedelta(minutes=20) if state < 0.65 or 0.95 <= state else None
        cancel = base + dt.timedelta(minutes=3) if 0.6 <= state < 0.92 else None
        rides.append((ride_id, user, _maybe(rng, rng.randrange(1, 9), 0.05), start, dropoff, cancel))
        for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]) if dropoff else rng.choice([0, 0, 0, 1])):
            status = rng.choice(["Approved"] * 6 + ["Decline", "Decline", None])
            amount = _maybe(rng, round(rng.uniform(0, 80), rng.choice([2, 2, 3])), 0.05)  # some below a cent
            tx.append((ride_id, amount, status))
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            review_id += 1
            reviewer = user if rng.random() < 0.9 else rng.randrange(1, 51)
            reviews.append((review_id, ride_id, reviewer, _maybe(rng, rng.randrange(1, 6), 0.06)))
    tx.append((999, 12.5, "Approved"))               # transaction of an unknown ride
    reviews.append((9999, 999, 3, 4))                # review of an unknown ride
    return {"app_downloads": downloads, "signups": signups, "ride_requests": rides,
            "transactions": tx, "reviews": reviews}


DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
              "timestamp_ntz": "TIMESTAMP"}


def load_duck(data):
    con = duckdb.connect()
    for name, rows in data.items():
        schema = TABLE_SCHEMAS[name]
        cols = [f.name for f in schema.fields]
        frame = pd.DataFrame(rows, columns=cols, dtype=object)
        con.register(f"{name}_raw", frame)
        casts = ", ".join(f"CAST({c} AS {DUCK_TYPES[f.dataType.simpleString()]}) AS {c}"
                          for c, f in zip(cols, schema.fields))
        con.execute(f"CREATE TABLE {name} AS SELECT {casts} FROM {name}_raw")
    return con


@pytest.fixture(scope="module", params=SEEDS)
def dataset(request, spark):
    data = generate(request.param)
    tables = RideTables(*[spark.createDataFrame(data[n], TABLE_SCHEMAS[n]) for n in TABLE_SCHEMAS])
    load = lambda spark, sf_dir: tables  # noqa: E731 - the random tables instead of the fixture
    store = SessionStore(load)
    registry = {**panel_queries(load, store), **exchange_queries(load, store), **store_queries(load, store)}
    return tables, load_duck(data), registry


SQL = core_sql("WITH")


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_core_query_matches_sql_on_random_data(dataset, name):
    tables, con, _ = dataset
    df = CORE_QUERIES[name](tables)
    cols = sorted(df.columns)
    assert spark_rows(df, cols) == duck_rows(con.sql(SQL[name]), cols)


DERIVED_SQL = derived_sql("WITH")
DERIVED_NAMES = sorted({**panel_queries(), **exchange_queries(), **store_queries()})


@pytest.mark.parametrize("name", DERIVED_NAMES)
def test_derived_query_matches_sql_on_random_data(dataset, name):
    tables, con, registry = dataset
    df = registry[name](tables.ride_requests.sparkSession, "unused")
    cols = sorted(df.columns)
    assert spark_rows(df, cols) == duck_rows(con.sql(DERIVED_SQL[name]), cols)
