"""Registered queries of display names, translated types and Korean brands, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions import names
from quillmart.operators import normalize
from quillmart.plans.views import view, with_views
from quillmart.shared import once_for_each

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


# ---- display names


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(t: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({t}, {_q('(?i)' + pattern)}, {_q(by)}, 'g')"


def _let(t: str, name: str, use: str) -> str:
    return f"list_transform([{t}], lambda {name}: {use})[1]"


def _strip(t: str, patterns: Sequence[str]) -> str:
    for p in patterns:
        t = _sub(t, p, r"\1" if p.startswith("([") else "")
    return t


def _key(t: str) -> str:
    return rf"lower(regexp_replace({t}, '[\s\-_./&|#·ㆍ:：,()\[\]]+', '', 'g'))"


def _enough(before: str, after: str) -> str:
    return f"CASE WHEN length({_key(after)}) >= {names.LEAST_KEY} THEN {after} ELSE {before} END"


def _literal(t: str) -> str:
    return rf"regexp_replace({t}, '([[:punct:]])', '\\\1', 'g')"


def _clean(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _brands(t: str, brands: Sequence[str], noise: bool) -> str:
    """Brands, the longest first, taken off the head of ``t``, or the noise before them with them."""
    for i, b in enumerate(brands):
        head = names.BEFORE_BRAND if noise else r"^\s*"
        pattern = f"concat({_q('(?i)' + head)}, {_literal(b)}, {_q(names.AFTER_BRAND)})"
        cut = _sub(f"regexp_replace(x{i}, {pattern}, '')", names.HEAD_DELIMITERS)
        cut = f"CASE WHEN regexp_matches(regexp_extract(x{i}, {pattern}, 1), {_q('(?i)' + names.BRAND_NOISE)}) THEN {cut} ELSE x{i} END" if noise else cut
        t = _let(t, f"x{i}", cut)
    return t


def display_sql(source: str, brands: Sequence[str], shade: str = "NULL") -> str:
    """Common table expressions ``shown (id, display)`` over ``source (id, name, ...)``; ``brands`` are Latin, the longest first."""
    t = _sub(_sub(_sub("text", names.HEAD_BRACKETS), names.HEAD_PARENTHESES), names.HEAD_OFFERS)
    t = _brands(_brands(t, brands, True), brands, False)
    t = _sub(_let(t, "c", _enough("c", _sub("c", names.HEAD_COUNT))), names.HEAD_DELIMITERS)
    for pattern, by in names.COUNT_PHRASES:
        t = _sub(t, pattern, by)
    t = _strip(t, (*names.PARENTHESES, names.BRACKETS, *names.PACKAGING, *names.SIZES))
    ending = f"regexp_replace(v, concat({_q('(?i)' + names.BEFORE_VARIANT)}, {_literal(shade)}, {_q('[)]]?' + chr(92) + 's*$')}), '')".replace("[)]]?", r"[)\]]?")
    t = _let(t, "v", f"CASE WHEN length({shade}) >= 2 THEN {_let(ending, 'w', _enough('v', 'w'))} ELSE v END")
    bare = _sub(_sub("text", names.UNWRAPPED[0], r" \1 "), names.UNWRAPPED[1], r" \1 ")
    return f"""
rounds AS (SELECT s.*, {_clean('name')} AS text, false AS done FROM {source} s WHERE name IS NOT NULL
  UNION ALL SELECT * EXCLUDE (next) REPLACE (next AS text, next = text AS done) FROM (SELECT *, {_clean(t)} AS next FROM rounds WHERE NOT done)),
shown AS (SELECT id, coalesce(nullif({_clean(_strip(_clean(bare), (*names.FLATTENED, *names.SIZES)))}, ''), {_clean('name')}) AS display FROM rounds WHERE done)"""


@query(
    f"WITH RECURSIVE {display_sql('retail_names', ('maker', 'brand'), 'shade')} SELECT id, display FROM shown",
    "retail_names",
)
def f22_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = view(spark, sf_dir, "retail_names")
    shown = {"display": names.display_name(F.col("name"), F.array("brand", "maker"), F.array("shade"))}
    return once_for_each(listed, {n: F.col(n) for n in ("name", "brand", "maker", "shade")}, shown).select("id", "display")


# ---- translated types

_TERMS = ", ".join(f"({i}, {_q(k)}, {_q(e)})" for i, (k, e) in enumerate(names.TYPE_TERMS))


@query(
    f"""
WITH terms(pos, term, english) AS (VALUES {_TERMS}),
n AS (SELECT p_partkey AS id, concat(p_brand, ' ', t1.term, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', t2.term) ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN ' 세트' ELSE '' END) AS name
      FROM part JOIN terms t1 ON t1.pos = p_partkey % {len(names.TYPE_TERMS)} JOIN terms t2 ON t2.pos = p_size),
b AS (SELECT id, name, arg_min(replace(name, term, english), row(-length(term), pos)) AS out FROM n JOIN terms ON contains(name, term) GROUP BY id, name)
SELECT n.id, n.name, CASE WHEN NOT regexp_matches(out, '[가-힣]') THEN out END AS translated FROM n LEFT JOIN b ON n.id = b.id"""
)
def f23_translated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    terms = F.array(*(F.lit(k) for k, _ in names.TYPE_TERMS))
    n = F.col("p_partkey")
    second = F.when(n % 3 == 0, F.concat(F.lit(" "), F.element_at(terms, F.col("p_size") + 1))).otherwise("")
    name = F.concat("p_brand", F.lit(" "), F.element_at(terms, (n % len(names.TYPE_TERMS) + 1).cast("int")), second, F.when(n % 7 == 0, " 세트").otherwise(""))
    made = p.select(n.alias("id"), name.alias("name"))
    return made.withColumn("translated", names.translated_type(F.col("name")))


# ---- Korean brands

#: Made-up Hangul names, one for each last digit of a brand's number.
_HANGUL = ("가람", "나루 빛", "다온", "라온 결", "마루", "바론", "사월", "아라 숲", "자온", "차오름")


def _hangul_name() -> Column:
    listed = F.array(*map(F.lit, _HANGUL))
    return F.concat(F.element_at(listed, F.substring("p_brand", -1, 1).cast("int") + 1), F.lit(" "), F.substring_index("p_brand", "#", -1))


def hangul_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of the part table, each with a Hangul name and its own."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct()
    spelled = brands.select(F.col("p_brand").alias("official_en"), F.posexplode(F.array(_hangul_name(), "p_brand")).alias("position", "alias"))
    return normalize.alias_table(spelled)


@query(
    f"""
WITH a AS (SELECT *, concat([{', '.join(map(_q, _HANGUL))}][CAST(right(p_brand, 1) AS INTEGER) + 1], ' ', split_part(p_brand, '#', 2)) AS alias, p_partkey % 5 <> 4 AS has FROM part),
m AS (SELECT p_partkey AS id, p_brand, alias, has, p_partkey % 6 AS k, CASE WHEN has THEN concat('[세트] ', alias, ' ', p_name) ELSE p_name END AS product_name_ko FROM a)
SELECT id, CASE WHEN k = 3 THEN '다른이름' WHEN has THEN alias WHEN k = 0 THEN replace(alias, ' ', '') END AS brand_ko,
  CASE WHEN k = 0 OR has THEN p_brand WHEN k = 5 THEN 'NEW' END AS brand_en, product_name_ko
FROM m"""
)
def n3_korean_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, none = F.col("p_partkey"), F.lit(None).cast("string")
    alias = _hangul_name()
    brand = F.when(n % 6 == 0, F.replace(alias, F.lit(" "), F.lit(""))).when(n % 6 == 1, "뿌리는").when(n % 6 == 2, "*[특가]").when(n % 6 == 3, "다른이름").when(n % 6 == 5, "NEW")
    records = p.select(
        n.cast("string").alias("source_product_id"), brand.alias("source_brand_name"), none.alias("source_brand_name_en"), F.when(n % 5 == 4, F.col("p_name")).otherwise(F.concat(F.lit("[세트] "), alias, F.lit(" "), "p_name")).alias("product_name_ko"),
        *(none.alias(c) for c in ("canonical_product_id", "product_name_en", "product_name_display_ko", "product_name_display_en", "category", "currency", "shade", "image_url", "description", "source_url", "updated_at")),
        *(F.lit(None).cast("double").alias(c) for c in ("regular_price", "original_price", "sale_price", "rating")), F.lit(None).cast("int").alias("review_count"), F.lit(None).cast("boolean").alias("sold_out"), F.lit("musinsa").alias("source"),
    )
    made = normalize.normalize_records(records, hangul_aliases(spark, sf_dir), "https://shop.example/")
    return made.select(F.col("source_product_id").cast("long").alias("id"), "brand_ko", "brand_en", "product_name_ko")
