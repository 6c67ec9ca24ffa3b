"""Every query against its SQL, and without SQL that it gives rows."""

import math
import os

import duckdb
import pytest

from highmark.plans import reader_queries, run_queries  # noqa: F401, register their queries
from highmark.plans.queries import ORACLE_SQL, QUERIES


def views(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rows = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rows.fetchall())


@pytest.mark.parametrize("name", ["q13_suppress_by_time", "q14_suppress_by_text", "q33_answers", "q46_largest_faces"])
def test_query_on_more_rows(spark, sf, name):
    """Ties and long chains that the smallest tables don't hold."""
    larger = sf.replace("sf0.001", "sf0.01")
    test_query(spark, larger, views(larger), name)


def test_rows_are_suppressed(spark, sf):
    from highmark.plans import roles

    clips = roles.clips(roles.points(spark, sf))
    assert 0 < QUERIES["q13_suppress_by_time"](spark, sf).count() < clips.count()
    assert 0 < QUERIES["q14_suppress_by_text"](spark, sf).count() < roles.table(spark, sf, "documents").count()
    assert QUERIES["q35_unfinished"](spark, sf).count() > 5 and QUERIES["q16_topic_shifts"](spark, sf).count() > 5
    assert QUERIES["q33_answers"](spark, sf).filter("end - start < 30").count() > 5
    assert QUERIES["q20_expand"](spark, sf).filter("not expanded").count() < clips.count()
