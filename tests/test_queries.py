"""Every query over the driver's tables against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from procurespark.plans.registry import ORACLE_SQL, QUERIES, load

load()
SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    shown = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v
    return sorted(str(tuple(map(shown, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    theirs = duck.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(mine.collect()) == plain(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_backfill_embeds_two_thirds(spark):
    made = QUERIES["q_backfill"](spark, SF).collect()
    assert sum(r.dimensions == 1024 for r in made) == sum(r.id % 3 != 0 for r in made) > 0


@pytest.mark.parametrize("name, node", [("q_enrich_invalid", "Join")])
def test_plan_has_no(spark, name, node):
    assert node not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def broadcast_rows(spark, after):
    """Rows of each broadcast of the runs whose number is over ``after``, and the last run's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    ids = [runs.apply(k).executionId() for k in range(runs.size())]
    for run in (k for k in ids if k > after):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return rows, max(ids, default=-1)


def test_match_materials_never_broadcasts_the_catalog(spark, tmp_path):
    """However small a catalog's file is, as it is compressed: broadcasts are made in the driver's memory."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT p.* REPLACE (p_partkey + 200 * r.r AS p_partkey) FROM '{SF}/part.parquet' p, (SELECT unnest(range(100)) AS r) r) TO '{tmp_path}/part.parquet'")
    con.sql(f"COPY (SELECT l.* REPLACE (l_partkey + 200 * (l_orderkey % 100) AS l_partkey) FROM '{SF}/lineitem.parquet' l) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    before = broadcast_rows(spark, float("inf"))[1]
    mine = QUERIES["q_match_materials"](spark, str(tmp_path))
    assert plain(mine.collect()) == plain(con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL['q_match_materials']})").fetchall())
    rows = broadcast_rows(spark, before)[0]
    assert rows and max(rows) < 2_000  # of 20,000 products
