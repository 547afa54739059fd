"""Queries against their SQL in DuckDB on the smallest tables: a few of each part, or all of them where ALL_QUERIES is set."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from taleloom.plans import all_oracles, all_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = all_queries(), all_oracles()
#: What SQL cannot say.
WITHOUT_SQL: set[str] = set()
FEW = """c03_cooccurrence c06_explicit_relations d01_parse d04_offsets d09_display e02_e03_failing_extractor e04_attributes e06_merge e06_mentions g01_build g03_betweenness g08_analytics g12_cytoscape g06_components_large g11_ego_nodes h03_order_importance
h08_nested_events h09_event_tree h10_scene_subtitle h17_select_item k04_delete k08_note_entities k15_standing l02_context l06_backlinks l08_find_note m08_entities m10_triples n01_parse_title n11_edit_title p01_tokens
r04_folder_tree r08_derive_folders r13_patch r15_delete_folder s01_s02_s04_s08_snapshots s05_export s07_registry t01_analytics_text w01_change_stream w02_sync x12_keyword_density x14_analyze_text z01_ids z06_data_url z07_entity_marks z07_other_marks""".split()

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FEW)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def against_sql(spark, name, tables):
    """Whether a query over tables of its own (name: a DuckDB SELECT) equals its SQL; and its rows."""
    import tempfile

    con = duckdb.connect()
    with tempfile.TemporaryDirectory() as d:
        for t, select in tables.items():
            con.execute(f"COPY ({select}) TO '{d}/{t}.parquet'")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        got, want = QUERIES[name](spark, d), con.execute(ORACLES[name])
        names, found = [c[0] for c in want.description], [tuple(r) for r in got.collect()]
        return rows(got.columns, found) == rows(names, want.fetchall()), sorted(found)


def test_order_of_times_finer_than_a_millisecond(spark):
    micros = "(1704692757002825), (1704692757003249), (1705324408641150), (1705324408641523), (-1500), (-1499), (-500), (-499), (499), (500), (1499), (1500)"
    events = f"SELECT row_number() OVER () - 1 AS event_id, make_timestamp(us) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 0.5 AS value FROM (VALUES {micros}) t(us)"
    for mode in ("reverse", "chronological", "importance"):
        assert against_sql(spark, f"h03_order_{mode}", {"events": events})[0]


def test_flow_score_on_a_border(spark):
    same, found = against_sql(spark, "x11_flow_score", {"documents": "SELECT 1::BIGINT AS doc_id, 'a a a a a. b b b b b. c c c. d d d.' AS text"})
    assert same and found == [(1, 12)]


def test_every_statistic_on_a_border(spark):
    documents = "SELECT * FROM (VALUES (1::BIGINT, 'a a a a a. b b b b b. c c c. d d d.'), (2, 'a. a b c. a b c. a'), (3, '...'), (4, ' ')) t(doc_id, text)"
    assert against_sql(spark, "x14_analyze_text", {"documents": documents})[0]


def test_every_statistic_of_odd_white_space_and_characters(spark):
    documents = r"SELECT * FROM (VALUES (1::BIGINT, 'a' || chr(11) || 'b. ' || chr(11) || '. c'), (2, chr(11)), (3, 'a' || chr(10) || chr(10) || chr(11) || chr(10) || chr(10) || 'b'), (4, chr(128512) || ' a.')) t(doc_id, text)"
    same, found = against_sql(spark, "x14_analyze_text", {"documents": documents})
    assert same and [r[:3] for r in found] == [(1, 3, 9), (2, 0, 1), (3, 2, 7), (4, 1, 4)]
    assert against_sql(spark, "x18_not_blank", {"conversations": f"SELECT doc_id AS conv_id, 0::BIGINT AS turn, text FROM ({documents})"})[0]
