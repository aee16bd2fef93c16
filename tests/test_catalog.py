"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyloom.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


#: Cells of 40 and 60 pairs, or 200 pairs of a pilot, are there on these tables too.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = duck.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert got == plain(want)


def test_sql_is_for_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


_K = "'{\"k\": ' || i // 40 % 10 || '}'"
_MADE = {
    "users of no arm": f"select i as event_id, case when i % 7 = 0 then null when i % 7 = 1 then -(i % 13) - 1 else i // 2 % 6 end as user_id, 'a' as event_type, i * 7 % 23 as value, {_K} as props from range(4000) t(i)",
    "arms of one polarity": f"select i as event_id, i % 12 as user_id, 'a' as event_type, i * 7 % 23 as value, {_K} as props from range(4000) t(i)",
    "one cell of one polarity": f"select i as event_id, case when i % 2 = 0 then i // 2 % 6 else 1 + i // 2 % 5 end as user_id, 'a' as event_type, i * 7 % 23 as value, {_K} as props from range(4000) t(i)",
    "one coverage": f"select i as event_id, i // 2 % 2 as user_id, 'a' as event_type, i * 7 % 23 as value, {_K} as props from range(4000) t(i)",
    "one arm": f"select i as event_id, i // 2 % 3 * 2 as user_id, 'a' as event_type, i * 7 % 23 as value, {_K} as props from range(4000) t(i)",
    "other arm, at the line": f"select i as event_id, i // 2 % 3 * 2 + 1 as user_id, 'a' as event_type, case when (i % 2 = 0) = (i // 40 % 5 >= 2) then 5 else 15 end as value, {_K} as props from range(4000) t(i)",
    "no value at a level": f"select i as event_id, i // 2 % 6 as user_id, 'a' as event_type, case when i % 2 = 0 and i // 40 % 5 = 2 then null else i * 7 % 23 end as value, {_K} as props from range(4000) t(i)",
    "nothing": "select 0 as event_id, 0 as user_id, 'a' as event_type, 1 as value, '' as props where false",
}


@pytest.mark.parametrize("case", sorted(_MADE))
def test_stage_is_decided_as_in_sql(spark, tmp_path, case):
    """Arms, coverages, levels or values that are not there do not stop the query."""
    con = duckdb.connect()
    con.sql(f"create table events as select event_id::bigint as event_id, user_id::bigint as user_id, event_type, value::double as value, props from ({_MADE[case]})")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = QUERIES["stage_decided"](spark, str(tmp_path))
    r = con.sql(ORACLE_SQL["stage_decided"])
    assert df.columns == r.columns and [tuple(x) for x in df.collect()] == r.fetchall()


def test_level_without_values_has_no_hits_in_gains(spark, tmp_path):
    """Answers that are all null at a level count as answers that do not hit, as single ones do."""
    con = duckdb.connect()
    con.sql(f"create table events as select event_id::bigint as event_id, user_id::bigint as user_id, event_type, value::double as value, props from ({_MADE['no value at a level']})")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    assert [tuple(x) for x in QUERIES["gains_exact"](spark, str(tmp_path)).collect()] == con.sql(ORACLE_SQL["gains_exact"]).fetchall()
