"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from siltstone import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load_all()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def rows(columns, found):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER), duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_pattern_cap_keeps_few_rows_before_the_shuffle(spark):
    plan = registry.QUERIES["pattern_cap"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_what_is_asked_for(spark):
    plan = registry.QUERIES["url_canonical"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = registry.QUERIES["pricing_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan


def test_footers_that_begin_alike_are_told_apart(spark, tmp_path):
    foot = lambda x: f'<html lang="en"><footer><div class="footer">{x}</div></footer></html>'
    found = ["About us 1", "Contact", "About us 22"]
    pages = [(i, f"https://a.example/{i}", foot(x)) for i, x in enumerate(found)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = registry.QUERIES["fragment_winners"](spark, str(tmp_path)).collect()
    assert [(r.site, r.locale, r.n, r.fragment) for r in rows] == [("a.example", "en", 2, '<div class="footer">About us 22</div>')]
