"""Registered queries against their SQL statements; DRIVESCOPE_ALL=1 runs every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("DRIVESCOPE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["W3_detect_dips", "J1_nearest_join", "J6_preferred_report", "A13_mismatch_verdict", "K13_ho_classify_intra", "A27_pilot_pollution_score", "K16_evaluate_a3", "J17_pair_by_position",
         "S2_absolute_time", "S9_sticky_states", "J13_serving_site_lookup", "K17_reconfiguration_properties", "K17_resolvers_from_json", "A16_core_metrics_by_tech", "A27_extended_profile", "K8_deep_scores"]
CHECKED = sorted(entry.oracle_sql()) if os.environ.get("DRIVESCOPE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        return None if x is None else (math.nan if x != x else float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in got.fetchall()]
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain(want)


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
