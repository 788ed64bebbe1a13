import os
import subprocess
import sys
from collections import Counter

import pytest

from tests.conftest import ROOT

NAMES = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)}).stdout.split()


def key(value):
    return "∅" if value is None or value != value else repr(round(float(value), 6)) if isinstance(value, float) else str(value)


def test_the_entry_needs_no_session_to_be_imported():
    assert "clause_split" in NAMES and "p2_found" in NAMES
    assert ("p1_found" in NAMES) == (ROOT / "farelode" / "llm" / "queries.py").exists()


def test_flagship(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_and_agrees_with_sql(spark, small, name):
    import duckdb

    import __spark_entry__

    found = __spark_entry__.queries()[name](spark, small)
    rows = [tuple(r[c] for c in sorted(found.columns)) for r in found.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows or name in ("p7_found",)
        return
    db = duckdb.connect()
    for f in sorted(os.listdir(small)):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert Counter(tuple(map(key, r)) for r in rows) == Counter(tuple(key(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated"])
def test_every_query_on_odd_tables(spark, small, tmp_path, kind):
    """Empty tables; rows with nothing but their number; every row three times, with further columns."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__

    kept = ("row_no", "request_id", "doc_id", "vec_id", "kind")
    for f in sorted(os.listdir(small)):
        t = pq.read_table(f"{small}/{f}")
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "nulls":
            t = t.slice(0, 5)
            t = pa.table({c.name: t[c.name] if c.name in kept else pa.nulls(len(t), c.type) for c in t.schema}, schema=t.schema)
        else:
            t = pa.concat_tables([t.slice(0, 20)] * 3)
            for name in ("typed", "key", "_text"):
                t = t.append_column(name, pa.array(["x"] * len(t)))
        pq.write_table(t, tmp_path / f)
    for name, query in __spark_entry__.queries().items():
        assert query(spark, str(tmp_path)).collect() is not None, name
