"""Line dedup by site-relative frequency: a line is boilerplate where too large a share of its host's pages holds it.

DataFrame functions only. What is counted are 64-bit line hashes per host, pre-aggregated before the shuffle; texts
are never shuffled by host, so a host with a third of all pages costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import written

#: A line goes where more than this share of its host's pages holds it.
MAX_RATIO = 0.05
#: ... and at least so many pages, or else every line of a host with few pages would go.
MIN_PAGES = 5
#: Boilerplate lines that are broadcast (8 bytes each and their hosts). More of them are joined by shuffling hashes.
BROADCAST_LINES = 20_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _page_lines(text: Column) -> Column:
    """Hashes of the different lines of a page, without blank ones."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _hash))


def boilerplate_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line, pages, ratio)``: hashes of the lines that exceed the ratio on their host.

    A page counts once for a line however often it repeats there; each row is a page, repeated rows too. Lines are
    compared without blanks at their ends. A null host counts as the empty host, a null text has no lines.
    """
    slim = pages.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = slim.select("host", F.explode(_page_lines(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.where(F.col("pages") >= min_pages).join(totals, "host")
    return often.withColumn("ratio", F.col("pages") / F.col("total")).where(F.col("ratio") > max_ratio).select("host", "line", "pages", "ratio")


def drop_boilerplate(
    pages: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Every page with its boilerplate lines taken out, all columns kept, and ``n_lines``, ``n_dropped`` added.

    Rows stay as they are in number; a page whose lines all go keeps an empty text, a null text stays null (with null
    counts). Kept lines keep their order and blanks. Columns called ``n_lines`` or ``n_dropped`` are replaced.
    """
    bad = written(boilerplate_lines(pages, text_col, host_col, max_ratio, min_pages).select("host", "line"), "boilerplate")
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*(F.col(c) for c in columns if c != text_col)).alias("page")  # packed, so that no column of the page meets one of ours
    slim = pages.select(row, F.col(text_col).alias("text"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    text = F.col("text")
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        by_host = bad.groupBy("host").agg(F.collect_set("line").alias("lines"))
        joined = slim.join(F.broadcast(by_host), "host", "left")
        own = joined.withColumn("bad", F.when(F.col("lines").isNotNull(), F.array_intersect(_page_lines(text), F.col("lines"))))
    else:
        # Hashes alone are shuffled by (host, line), and what each page has of them by the page's own key.
        keyed = slim.withColumn("id", F.xxhash64(F.col("page").getField(id_col), "host", "text"))
        found = keyed.select("id", "host", F.explode(_page_lines(text)).alias("line"))
        by_page = found.join(bad, ["host", "line"], "left_semi").groupBy("id").agg(F.collect_set("line").alias("bad"))
        own = keyed.join(by_page, "id", "left")
    none = F.array().cast("array<bigint>")
    lines, gone = _lines(text), F.coalesce(F.col("bad"), none)
    kept = F.filter(lines, lambda x: ~F.array_contains(gone, _hash(x)))
    clean = F.when(F.size(gone) == 0, text).otherwise(F.array_join(kept, "\n"))
    n_lines = F.size(lines).cast("long")
    n_dropped = F.when(text.isNotNull(), F.when(F.size(gone) == 0, 0).otherwise(n_lines - F.size(kept)).cast("long"))
    values = (clean.alias(c) if c == text_col else F.col("page").getField(c).alias(c) for c in columns)
    made = own.select(F.struct(*values).alias("page"), F.when(text.isNotNull(), n_lines).alias("n_lines"), n_dropped.alias("n_dropped"))
    return made.select("page.*", "n_lines", "n_dropped")


#: The same result in DuckDB, lines compared as text.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d),
c AS (SELECT host, line, count(*) AS pages FROM l WHERE line <> '' GROUP BY ALL),
t AS (SELECT host, count(*) AS total FROM d GROUP BY ALL),
b AS (SELECT c.host, list(c.line) AS bad FROM c JOIN t ON c.host = t.host
      WHERE pages >= {MIN_PAGES} AND pages / total > {MAX_RATIO} GROUP BY c.host),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS kept
      FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM k
"""
