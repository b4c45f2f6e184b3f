"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracles import TABLES, _rows

SF = "/root/testdata/sf0.001"
NAMES = ["gini_complexity", "distance_threshold", "match_kmers_all", "hsg_groups", "ungapped_extend", "shuffled_db",
         "overlap_removal", "result_table"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry_module.queries()[name](spark, SF)
    cursor = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == _rows(names, cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_users_of_many_tiles_do_not_change_results(spark):
    """Targets of many tiles give what SQL gives for whole profiles, and keep their names."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    for name in ("match_kmers_tiled", "ungapped_extend_tiled", "search_ungapped_tiled"):
        frame = entry_module.queries()[name](spark, SF)
        cursor = con.execute(entry_module.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        rows = frame.collect()
        assert rows and _rows(frame.columns, rows) == _rows(names, cursor.fetchall())
        target = "DB field" if "DB field" in frame.columns else "target_id"
        assert all(r[target].isdigit() for r in rows)


LONG_ROWS = ["cap", "trim_range", "kmer_windows", "missing_filter", "gini_complexity", "hamming", "base_score",
             "seq_base_score", "shuffle_count", "chunk_layout", "ordinals", "draws", "shuffled_db_long", "stockholm_text",
             "null_scores_ungapped"]


def test_a_user_of_many_tiles_is_never_one_group(spark, tmp_path, monkeypatch):
    """One user with a third of the rows: same results as SQL, without a row that holds all of that user."""
    from functools import cached_property

    from catalog.queries import Source
    from profseek.operators import tiles

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)
                FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")

    def whole(self):
        raise AssertionError("a whole profile was gathered")

    monkeypatch.setattr(Source, "db", cached_property(whole))
    Source.db.__set_name__(Source, "db")
    monkeypatch.setattr(tiles, "PIECE", 32)
    for name in LONG_ROWS:
        frame = entry_module.queries()[name](spark, str(tmp_path))
        cursor = con.execute(entry_module.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = _rows(names, cursor.fetchall())
        assert want and _rows(frame.columns, frame.collect()) == want, name
