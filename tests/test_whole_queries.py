"""Registered queries over all rows against their registered SQL."""

from functools import cache

import pytest

from quillmart.plans.review_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@cache
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cursor):
    return sorted((tuple(round(float(x), 2) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in cursor), key=repr)


def answer(name):
    return rows(database().execute(ORACLE_SQL[name]).fetchall())


def test_offers_of_every_product_are_attached(spark):
    got = rows(QUERIES["j12_attach_offers"](spark, SF).collect())
    assert got == answer("j12_attach_offers")
    assert {r[0] % 20 for r in got} == set(range(20))


@pytest.mark.parametrize("name", ["r7_document_scores", "r8_match_ranks", "j9_search_catalog", "f27_editor_lines"])
def test_all_parts_are_asked_and_answered(spark, name):
    got = sorted(map(repr, rows(QUERIES[name](spark, SF).collect())))
    assert got == sorted(map(repr, answer(name)))
