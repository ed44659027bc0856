"""The driver's contract on the smallest tables: every query of the library against its SQL."""

import os

import duckdb
import pytest

from strandmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float) and x == int(x):
        return int(x)
    return list(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(repr(plain(tuple(r[c] for c in order))) for r in df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == order
        at = [names.index(c) for c in order]
        assert got == sorted(repr(plain(tuple(r[i] for i in at))) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming(spark, tmp_path):
    from strandmill.streaming import enrich

    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = enrich.enriched(enrich.events(spark, str(tmp_path / "in"), events.schema), events.select("event_type").distinct(), ["event_type"])
    q = enrich.windowed(stream).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT coalesce(sum(n), 0) FROM counts").first()[0] <= events.count()
