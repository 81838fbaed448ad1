import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in __spark_entry__.oracle_sql()]


def plain(df):
    def text(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got, want = __spark_entry__.queries()[name](spark, FOLDER).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry_and_stream(spark, tmp_path):
    import json

    from scriptorium import streaming

    assert __spark_entry__.entry(spark).count() > 0
    (tmp_path / "in").mkdir()
    doc = json.dumps({"pages": [{"blocks": [{"text": "a"}]}]})
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"upload_id": i, "received_at": "2024-01-01T00:00:00", "payload": doc}) for i in (1, 1, 2)))
    q = streaming.flat_stream(streaming.uploads(spark, str(tmp_path / "in")), fields=False).writeStream.format("memory").queryName("flat").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("flat").count() == 4
