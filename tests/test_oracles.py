"""Every query with a SQL twin gives the twin's rows on the smallest driver tables."""

import os

import duckdb
import pytest

from skeinwork.demo import TABLES
from skeinwork.queries import ORACLES, QUERIES

DIR = os.environ.get("SKEINWORK_TEST_DIR", "/root/testdata/sf0.001")
#: A spread of operators; SKEINWORK_ALL_TWINS=1 runs every twin.
SPREAD = ("s1_repository_scan", "s8_yaml_records", "s10_rule_files", "k9_import", "p13_run_outcomes", "k6_reconcile", "f6_ambiguity_guard", "f10_edge_validity", "j3_call_resolution", "j7_deepest_package", "impact", "g2_bfs_cyclic", "g7_paths_to", "g9_find_paths", "g11_flow_impact", "a6_token_report", "a8_scorecards", "a17_ownership", "p8_memory_gc", "w6_greedy_packing", "p5_context_build", "p10_learning", "c7_cost")
NAMES = sorted(ORACLES) if os.environ.get("SKEINWORK_ALL_TWINS") else SPREAD

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    twin = duck.sql(ORACLES[name])
    assert sorted(twin.columns) == cols
    at = [twin.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in twin.fetchall())


def test_every_query_is_named_and_twinned():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
