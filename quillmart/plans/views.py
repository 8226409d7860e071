"""Views over the driver tables that give listings, query logs, decisions and jobs at scale.

Each is one SQL text that Spark and DuckDB both accept, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from quillmart.shared import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "listing_obs": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS seq, l.l_partkey AS part_no, l.l_suppkey AS supp_no, l.l_extendedprice AS tie,
       l.l_shipdate AS observed_at,
       CASE WHEN p.p_partkey % 10 <> 0 THEN concat('part:', CAST(p.p_partkey AS varchar(20))) END AS canonical_product_id,
       CASE l.l_suppkey % 6 WHEN 0 THEN 'oliveyoung' WHEN 1 THEN 'oliveyoung-global' WHEN 2 THEN 'musinsa'
            WHEN 3 THEN 'official' WHEN 4 THEN 'coupang' ELSE 'hwahae' END AS source,
       CASE WHEN l.l_linenumber <> 7 THEN concat('P', CAST(p.p_partkey AS varchar(20)), 'S', CAST(l.l_suppkey AS varchar(20))) END AS source_product_id,
       CASE WHEN l.l_linenumber % 5 <> 0 THEN p.p_brand END AS source_brand_name,
       concat('[', p.p_type, '] ', p.p_brand, ' ', p.p_name, ' ', CAST(p.p_size AS varchar(20)), 'ml') AS product_name_en,
       p.p_type AS category,
       p.p_retailprice AS original_price,
       CASE WHEN l.l_discount > 0 THEN p.p_retailprice * (1 - l.l_discount) END AS sale_price,
       concat('https://shop.example/', CAST(p.p_partkey AS varchar(20)), '/', CAST(l.l_suppkey AS varchar(20))) AS source_url
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "query_log": """
SELECT e.event_id AS seq, e.ts, e.user_id, p.p_name AS query,
       CAST(floor(e.value) AS bigint) % 12 AS result_count, e.value AS elapsed_ms,
       e.event_type = 'error' AS failed
FROM events e JOIN part p ON p.p_partkey = e.event_id % 100""",
    "jobs": """
SELECT o_orderkey AS id, concat('job:', CAST(o_orderkey AS varchar(20))) AS job_key, 'search' AS kind,
       CAST(o_orderkey AS varchar(20)) AS query,
       CAST(substring(o_orderpriority, 1, 1) AS int) * 10 AS priority,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
       CAST(o_custkey % 4 AS int) AS attempt_count, 3 AS max_attempts,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('error ', CAST(o_custkey AS varchar(20))) END AS last_error,
       o_orderdate AS started_at, o_orderdate AS last_seen_at, o_orderdate AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at, CAST(o_custkey % 6 AS int) AS product_count
FROM orders""",
    "judged": """
SELECT l_orderkey * 10 + l_linenumber AS seq,
       CASE l_suppkey % 4 WHEN 0 THEN 'oliveyoung' WHEN 1 THEN 'official:global' WHEN 2 THEN 'musinsa' ELSE '' END AS source,
       CASE WHEN l_orderkey % 3 <> 0 THEN 'https://shop.example/1' END AS source_url,
       CASE WHEN l_linenumber < 4 THEN concat('P', CAST(p_partkey AS varchar(20))) END AS source_product_id,
       concat('part:', CAST(p_partkey AS varchar(20))) AS canonical_product_id,
       CASE WHEN l_linenumber % 3 = 0 THEN p_type END AS brand_ko, CASE WHEN l_linenumber <> 4 THEN p_brand END AS brand_en,
       CASE WHEN l_linenumber < 6 THEN p_name END AS product_name_ko, CASE WHEN l_orderkey % 5 = 0 THEN p_name END AS product_name_en,
       CASE l_orderkey % 11 WHEN 0 THEN concat('[', p_type, '] ', p_name) WHEN 1 THEN concat(p_name, ' SPF50+ PA++++') WHEN 2 THEN concat(p_name, ' 50ml*2입')
            WHEN 3 THEN concat(p_name, ' 30g 증량') WHEN 4 THEN concat(p_brand, ' ', p_name) WHEN 5 THEN concat(p_type, '-', p_name) WHEN 6 THEN p_brand
            WHEN 7 THEN concat(p_name, ' 3종 spf 30 pa+ mild') WHEN 8 THEN '' WHEN 9 THEN p_name END AS product_name_display_ko,
       CASE WHEN l_linenumber = 2 THEN p_name END AS override_ko, CASE WHEN l_linenumber = 5 THEN p_name END AS override_en,
       CASE WHEN l_discount > 0.02 THEN p_retailprice END AS price, CASE WHEN l_quantity > 10 THEN 'img' END AS image_url,
       CASE WHEN l_tax > 0.04 THEN 4.0 END AS rating, CAST(NULL AS int) AS review_count
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "retail_names": """
SELECT p_partkey AS id, p_brand AS brand, concat('Maker of ', p_type) AS maker, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS shade,
       CASE p_partkey % 18
            WHEN 0 THEN concat('[6월 올영픽] ', p_brand, ' ', p_name, ' ', CAST(p_size AS varchar(20)), ' Colors (단품/더블)')
            WHEN 1 THEN concat('[NEW][1위]NEW ', 'Maker of ', p_type, ' | ', p_brand, ' ', p_name, ' 14g 8종 (기획/단품)')
            WHEN 2 THEN concat('뿌리는 로션 ', p_brand, '  ', p_name, ' 200ml')
            WHEN 3 THEN concat(p_brand, ' ', p_name, ' 300ml 리필기획(+', CAST(p_size AS varchar(20)), 'ml 증정)')
            WHEN 4 THEN concat(p_brand, ' 3종 ', p_name, ' (흑갈색/자연갈색) 중 택 1')
            WHEN 5 THEN concat(p_name, ' ', CAST(p_size AS varchar(20)), 'ml+30ml 듀오기획')
            WHEN 6 THEN concat('Maker of ', p_type, ' ', p_name, ' 다운타임 3종 키트 (세럼 40ml+크림60ml)')
            WHEN 7 THEN concat(p_name, ' (', p_type, ') 10 Colors')
            WHEN 8 THEN concat(p_name, ' 40g 2colors SPF 50 PA++++')
            WHEN 9 THEN concat(p_brand, ' ', p_name, ' ', CAST(p_size AS varchar(20)), 'ml + 65ml 대용량 기획세트')
            WHEN 10 THEN concat('(', 'Maker of ', p_type, 'X', p_type, ') ', p_name, '15g 블랙/브라운 단품/기획')
            WHEN 11 THEN concat('[', p_type, '] ', p_name, ' [', p_type, ']')
            WHEN 12 THEN concat(p_name, ' 1.5ml*', CAST(p_size AS varchar(20)), 'ea')
            WHEN 13 THEN concat(p_name, ' ', CAST(p_size AS varchar(20)), ' pcs extra')
            WHEN 14 THEN concat('올영 단독 ', p_brand, ' - ', p_name, ' 단독기획(', p_type, ')')
            WHEN 15 THEN concat(p_name, ' / ', p_type)
            WHEN 16 THEN concat('[', p_brand, ']')
            ELSE concat(p_brand, ' ', p_name, ' SPF', CAST(p_size AS varchar(20)), '+ , PA+++ ', p_type) END AS name
FROM part""",
    "decisions": """
SELECT o_orderkey AS seq, o_custkey AS match_no, o_orderdate AS decided_at,
       CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' ELSE 'pending_review' END AS decision,
       concat('clerk', CAST(o_orderkey % 7 AS varchar(20))) AS reviewer
FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str, of_part: dict[str, Column] | None = None, **frames: DataFrame) -> DataFrame:
    """View ``name`` over the Parquet tables below ``sf_dir``, or ``frames`` in place of them.

    ``of_part`` are further columns, made of a part's alone: once for each part, on all cores, before line items are joined.
    """
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql and t not in frames} | frames
    if of_part:
        frames["part"] = spread(frames["part"]).withColumns(of_part)
        sql = sql.replace("\nFROM lineitem", f", {', '.join(f'p.{c}' for c in of_part)}\nFROM lineitem")
    for t, df in frames.items():
        sql = _named(sql, t)
    return spark.sql(sql, **frames)


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that may use the named views."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def sql_key(expression: str, service: bool = False) -> str:
    """The search key (or service key) of a DuckDB expression."""
    from quillmart.functions.text import SERVICE_REPLACEMENTS, TEXT_REPLACEMENTS

    out = f"replace(lower(trim(regexp_replace(coalesce({expression}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
    for a, b in TEXT_REPLACEMENTS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '[\\s\\-_./|+&''():\\[\\],]+', '', 'g')"
    for a, b in SERVICE_REPLACEMENTS if service else ():
        out = f"replace({out}, '{a}', '{b}')"
    return out
