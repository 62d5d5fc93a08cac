"""The registered queries against their SQL on the smallest tables, and the stream."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from agromix.queries import ORACLES, QUERIES  # noqa: E402
from agromix.streaming.sums import moments, running_moments  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    out = QUERIES[name](spark, folder)
    names = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in out.collect()), key=str)
    assert got
    if name in ORACLES:
        db = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events embeddings".split():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        cursor = db.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == names
        expected = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=str)
        assert got == expected


def test_running_moments(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_moments(stream, ["event_type"], "value", "running")
    query.processAllAvailable()
    query.stop()
    got = {r["event_type"]: (r["n"], round(r["sum_y"], 6)) for r in spark.sql("SELECT * FROM running").collect()}
    assert got == {r["event_type"]: (r["n"], round(r["sum_y"], 6)) for r in moments(table, ["event_type"], "value").collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 2
