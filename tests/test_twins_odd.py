"""Queries and their SQL twins on small tables of odd rows."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skeinwork.demo import TABLES
from skeinwork.queries import ORACLES, QUERIES

DAY = datetime.datetime(2024, 1, 1)
DEFAULT = {
    "region": [{"r_regionkey": 0, "r_name": "R"}],
    "nation": [{"n_nationkey": 0, "n_name": "N", "n_regionkey": 0}],
    "customer": [{"c_custkey": 0, "c_name": "C", "c_nationkey": 0}],
    "supplier": [{"s_suppkey": 0, "s_name": "S", "s_nationkey": 0}],
    "part": [{"p_partkey": 0, "p_name": "P", "p_brand": "B", "p_type": "T", "p_size": 1}],
    "orders": [{"o_orderkey": 0, "o_custkey": 0, "o_orderstatus": "F", "o_orderdate": DAY, "o_orderpriority": "LOW"}],
    "lineitem": [{"l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0, "l_linenumber": 1, "l_quantity": 1.0, "l_returnflag": "N"}],
    "events": [{"event_id": 0, "ts": DAY, "user_id": 0, "event_type": "view", "value": 1.0, "props": '{"k": 1}'}],
    "documents": [{"doc_id": 0, "text": "a", "lang": "en", "source": "web", "n_chars": 1}],
    "embeddings": [{"vec_id": 0}],
    "pages": [{"page_id": 0, "url": "http://a.x/", "html": ""}],
    "benchmark": [{"item_id": 0, "text": "a"}],
    "labels": [{"doc_id": 0, "quality": 1, "toxic": 0}],
    "conversations": [{"conv_id": 0, "turn": 0, "role": "user", "text": "a"}],
}


@pytest.fixture
def agree(spark, tmp_path):
    """Holds a query over the given rows, and one row of each other table, against its twin; the rows."""

    def check(name, **rows):
        con = duckdb.connect()
        for t in TABLES:
            pq.write_table(pa.Table.from_pylist(rows.get(t, DEFAULT[t])), f"{tmp_path}/{t}.parquet", coerce_timestamps="us")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        twin = con.execute(ORACLES[name])
        at = [[d[0] for d in twin.description].index(c) for c in cols]
        assert got == sorted((tuple(r[k] for k in at) for r in twin.fetchall()), key=repr)
        return [dict(zip(cols, r, strict=True)) for r in got]

    return check


def test_notes_end_at_the_next_heading(agree):
    head = "é" * 100
    texts = [head + "### more é\nand more", head + "kept\n## not kept", "## Decision\nearly\n##late" + head, head + "\x0b\x0c", "", head + "x" * 700, None]
    rows = agree("s9_notes", documents=[{**DEFAULT["documents"][0], "doc_id": k + odd, "text": t} for k, t in zip(range(0, 20, 2), texts) for odd in (0, 1)])
    assert {r["ref"]: r["content"] for r in rows}["0.md"] == "## Decision"
    assert {r["ref"]: r["content"] for r in rows}["2.md"] == "## Decision\nkept"
    assert {r["ref"]: r["content"] for r in rows}["5.md"] == "## Decision\nearly"


def test_migrations_change_the_last_version(agree):
    assert {(r["label"], r["version"]) for r in agree("k7_migrations")} == {("n", 3), ("r", 3), ("c", 3), ("s", 3), ("p", 3)}
