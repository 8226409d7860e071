"""Scalar functions and keys on inline rows, with the values that the functions they re-express give."""

import pytest
from pyspark.sql import functions as F

from quillmart.functions import keys, text


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, c string" if not isinstance(rows[0], tuple) else "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(df.select("i", *columns).collect())]


def c():
    return F.col("c")


def test_clean_text(spark):
    assert values(spark, ["  a \t\n b ", "", "   ", None, "a b"], text.clean_text(c())) == ["a b", None, None, None, "a b"]


@pytest.mark.parametrize("function, want", [("parse_krw_price", [12000, None, None, None, None, 5]), ("parse_krw_display_price", [12000, 12000, 9000, None, None, 5])])
def test_prices(spark, function, want):
    assert values(spark, ["12,000원", "12,000~15,000", "9,000원부터", "무료", None, "5"], getattr(text, function)(c())) == want


def test_urls(spark):
    got = values(spark, ["//img/x.jpg", "/a/b", "c.jpg", "https://h/x", None, " "], text.absolute_url(c(), "https://shop.example/list/all"))
    assert got == ["https://img/x.jpg", "https://shop.example/a/b", "https://shop.example/list/c.jpg", "https://h/x", None, None]


def test_languages(spark):
    assert values(spark, ["가나", "abc", "가 a", "123", None], text.name_language(c())) == ["ko", "latin", "mixed", "unknown", "unknown"]


def test_search_key_replaces_in_order(spark):
    # "foundation" comes before "foundations" and "gloss" before "lip gloss": earlier replacements hide later ones.
    got = values(spark, ["Lip Gloss", "foundations", "Eye-Shadow (A/B)", "STRASSE straße", None, "CC cream"], text.search_key(c()))
    assert got == ["lip글로스", "파운데이션s", "아이섀도ab", "strassestrasse", "", "CC크림"]
    assert values(spark, ["glowy vitamin c"], text.service_key(c())) == ["글로이비타"]


def test_tokens_and_terms(spark):
    assert values(spark, ["Ab-1 가나!", None], text.tokens(c())) == [["ab", "1", "가나"], []]
    got = values(spark, ["Brand#10 ab cdefg"], text.query_terms(c()))[0]
    assert got[:6] == ["brand", "10", "ab", "cdefg", "brand#10abcdefg", "br"] and len(got) == 32 and len(set(got)) == 32
    assert values(spark, ["abc", "a", ""], text.compact_ngrams(c(), 2, 8)) == [["abc", "ab", "bc", "abc"], [], []]


def test_dedupe_keeps_first_spelling(spark):
    got = values(spark, ["A| a |b||B|c"], text.dedupe_texts(F.split(c(), r"\|")))
    assert got == [["A", "b", "c"]]


def test_lenient_parsers(spark):
    assert values(spark, ["1,203", "x", None, "4.5"], text.parse_number(c())) == [1203.0, None, None, 4.5]
    assert values(spark, ["TRUE", "soldout", "0", "in_stock", "?", None], text.parse_bool(c())) == [True, True, False, False, None, None]
    assert values(spark, ['["a"," b "]', "x | y", "[broken", "", None], text.parse_options(c())) == [["a", "b"], ["x", "y"], ["[broken"], None, None]
    assert values(spark, ["4.8점", "4,5 / 5", "9점", "none"], text.rating_from_text(c())) == [4.8, 4.5, None, None]
    assert values(spark, ["리뷰 1,234건", "Review 7", "12개"], text.review_count_from_text(c())) == [1234, 7, None]
    assert values(spark, ["₩12.5", "0", "x", None], text.is_positive_price(c())) == [True, False, False, False]
    assert values(spark, ["https://a", "https:https://a", "//a", None], text.is_usable_image_url(c())) == [True, False, False, False]


def test_names_and_lines(spark):
    assert values(spark, ["[x] [y] Brand lip", "[x]", "no badge", None], text.brand_from_name(c())) == ["Brand", None, "no", None]
    assert values(spark, ["- a\n2) B\n b \n\n• c", " "], text.batch_lines(c())) == [["a", "B", "c"], [""]]
    got = values(spark, [("Clio kill cover", "CLIO"), ("a.b a.b c", "a.b"), ("x", ""), ("x", None), ("only", "ONLY")], text.without_brand(F.col("c0"), F.col("c1")))
    assert got == ["kill cover", "a.b c", "x", "x", ""]


def test_sources(spark):
    col = c()
    got = values(spark, ["oliveyoung", "oliveyoung-global:jp", "musinsa:x", "other", None], keys.source_label(col), keys.source_priority(col), keys.source_kind(col), keys.source_allowed(col, ["musinsa", " "]))
    assert got == [("Olive Young", 10, "retailer", False), ("Olive Young Global", 15, "retailer", False), ("Musinsa", 30, "retailer", True), ("other", 1000, None, False), (None, 1000, None, False)]


def test_record_keys(spark):
    parts = [F.col(f"c{k}") for k in range(5)]
    rows = [("oliveyoung", "A1", "b", "n", "u"), ("musinsa", "A1", "B b", "N-n", "u"), ("musinsa", "A1", None, "n", "u"), ("musinsa", None, None, "n", "http://x/1"), ("oliveyoung:x", "A2", None, None, None)]
    assert values(spark, rows, keys.index_record_key(*parts)) == ["oliveyoung:A1", "product:bb:nn", "musinsa:A1", "musinsa:httpx1", "oliveyoung:A2"]
    assert values(spark, rows, keys.collection_record_key(*parts)) == ["oliveyoung:A1", "musinsa:A1", "musinsa:A1", "musinsa:httpx1", "oliveyoung:x:A2"]
    assert values(spark, [("Search! x", "Lip  Tint"), (None, "q")], keys.job_key(F.col("c0"), F.col("c1"))) == ["search-x:립틴트", "oliveyoung-search:q"]
