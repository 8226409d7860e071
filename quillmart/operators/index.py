"""The product index: texts and terms of records, alias terms, and search by mapped results, full text and query expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.text import batch_lines, clean_text, compact_ngrams, dedupe_texts, has_hangul, let, search_key, service_key, tokens, without_brand
from quillmart.operators.containment import join_inside
from quillmart.operators.matching import match_scores, rank_matches, token_classes
from quillmart.operators.search import build_postings, equal_documents, expand_aliases, search_bm25, search_substring, search_tiers
from quillmart.shared import once_for_each, spread, stored

#: Text columns of a record, in the order their terms are listed, and its array columns.
TEXTS = (
    "source_brand_name", "source_brand_name_en", "product_name_ko", "product_name_en", "product_name_display_ko", "product_name_display_en", "category", "description", "shade", "source_product_id",
)
LISTS = ("options", "search_keywords")
#: Alias keys that a name contributes to a record's alias terms: the longest ones.
NAME_ALIASES = 8


def _value(df: DataFrame, name: str) -> Column:
    """A text column, or an array column joined by blanks; null where it is empty or the frame lacks it."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.array_join(name, " ") if name in LISTS else F.col(name), F.lit(""))


def search_text(records: DataFrame) -> Column:
    """the search key of all texts of a record, its canonical id among them."""
    names = (*TEXTS[:2], "canonical_product_id", *TEXTS[2:], *LISTS)
    return search_key(F.concat_ws(" ", *(_value(records, n) for n in names)))


def search_terms(records: DataFrame) -> Column:
    """the terms of a record, each once: of every text its folded form, its tokens, its key and n-grams of the key."""

    def of_text(t: Column) -> Column:
        key = search_key(t)
        return F.concat(F.array(F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))), tokens(t), let(key, lambda k: compact_ngrams(k)))

    texts = F.filter(F.array(*(F.trim(_value(records, n)) for n in (*TEXTS, *LISTS))), lambda t: t.isNotNull() & (t != ""))
    # Every term is folded already, so equal terms are equal texts.
    return F.filter(F.array_distinct(F.flatten(F.transform(texts, of_text))), lambda t: t != "")


def indexed_columns(records: DataFrame) -> list[str]:
    """The columns of a frame that its terms are made of."""
    return [n for n in (*TEXTS, *LISTS) if n in records.columns]


def with_search_terms(records: DataFrame, out: str = "terms") -> DataFrame:
    """records with their :func:`search_terms`, joined by blanks, made once for records of equal texts."""
    columns = indexed_columns(records)
    frame = records.select(*columns)
    return once_for_each(records, {n: F.col(n) for n in columns}, {out: F.array_join(search_terms(frame), " ")})


def alias_lists(aliases: DataFrame) -> DataFrame:
    """``(official_en, spoken)``: the aliases of a brand, those in Hangul first, then shorter ones. ``aliases`` has ``alias,
    official_en``; a brand has some dozens of aliases."""
    order = F.struct(F.when(has_hangul(F.col("alias")), 0).otherwise(1).alias("latin"), F.length("alias").alias("size"), "alias")
    return aliases.where(F.col("alias").isNotNull()).groupBy("official_en").agg(F.sort_array(F.collect_set(order))["alias"].alias("spoken"))


def alias_terms(records: DataFrame, aliases: DataFrame, key_col: str) -> DataFrame:
    """``(key, aliases)``: all aliases of the brands that a record's brand columns name or that its names mention.

    Brands come in the order brand, English brand, then the aliases inside the Korean and the English name, the longest
    first and at most NAME_ALIASES of each name. Names are cut once each, however many records have them. Records
    without a brand have no row.
    """
    keyed = aliases.select(search_key(F.col("alias")).alias("alias_key"), "official_en").where(F.col("alias_key") != "").distinct()
    fields = F.array(*(F.struct(F.lit(i).alias("field"), search_key(_value(records, n)).alias("text_key")) for i, n in enumerate(TEXTS[:4])))
    rows = records.select(F.col(key_col).alias("key"), F.explode(fields).alias("f")).select("key", "f.*").where(F.col("text_key") != "")
    named = rows.where(F.col("field") < 2).join(keyed, F.col("text_key") == F.col("alias_key")).select("key", "field", F.lit(0).alias("no"), "official_en")
    names = rows.where((F.col("field") >= 2) & (F.length("text_key") >= 2))
    met = join_inside(names.select("text_key").distinct(), "text_key", keyed.select("alias_key").distinct(), "alias_key")
    longest = Window.partitionBy("text_key").orderBy(F.length("alias_key").desc(), "alias_key")
    met = met.withColumn("no", F.row_number().over(longest)).where(F.col("no") <= NAME_ALIASES).join(keyed, "alias_key").select("text_key", "no", "official_en")
    inside = names.join(met, "text_key").select("key", "field", "no", "official_en")
    brands = named.unionByName(inside).groupBy("key", "official_en").agg(F.min(F.struct("field", "no")).alias("at"))
    spoken = brands.join(alias_lists(aliases), "official_en")
    ordered = spoken.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "official_en", "spoken"))).alias("b"))
    return ordered.select("key", dedupe_texts(F.flatten(F.col("b.spoken"))).alias("aliases"))


def index_columns(records: DataFrame, aliases: DataFrame, key_col: str) -> DataFrame:
    """``(doc, brand, names, category, description, shade, options, aliases, search_terms)``: what is indexed of a record."""
    joined = lambda *names: F.concat_ws(" ", *(_value(records, n) for n in names))
    own = records.select(
        F.col(key_col).alias("doc"), joined(*TEXTS[:2]).alias("brand"), joined(*TEXTS[2:6]).alias("names"), joined("category").alias("category"), joined("description").alias("description"), joined("shade").alias("shade"),
        joined("options").alias("options"), F.array_join(search_terms(records), " ").alias("search_terms"),
    )
    spoken = alias_terms(records, aliases, key_col).select(F.col("key").alias("doc"), F.array_join("aliases", " ").alias("aliases"))
    return own.join(spoken, "doc", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def indexed_text() -> Column:
    """The text of :func:`index_columns` that postings are built of."""
    return F.concat_ws(" ", "brand", "names", "category", "description", "shade", "options", "aliases", "search_terms")


def product_postings(records: DataFrame, aliases: DataFrame, key_col: str) -> DataFrame:
    """The postings of all that is indexed of a record: its eight columns, alias terms and n-grams among them."""
    return build_postings(index_columns(records, aliases, key_col), "doc", indexed_text())


def head_postings(records: DataFrame, aliases: DataFrame, key_col: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, members)``: :func:`product_postings` of the heads of records that are indexed alike, and ``(head, doc)`` of
    every record."""
    heads, members = equal_documents(records, key_col, indexed_columns(records))
    return product_postings(spread(heads), aliases, key_col), members


def mapped_hits(queries: DataFrame, ranks: DataFrame, products: DataFrame, k: int, key_col: str = "record_key", time_col: str = "last_seen_at") -> DataFrame:
    """``(query_id, doc, rank)``: products mapped to a query's key, by rank, then the one seen last, then key; at most ``k``.

    ``ranks`` has ``query_key, product_key, rank``. Mapped keys without a product are left out.
    """
    asked = queries.select("query_id", search_key(F.col("query")).alias("query_key")).where(F.col("query_key") != "")
    known = products.select(F.col(key_col).alias("product_key"), F.col(time_col).alias("seen"))
    met = asked.join(ranks.select("query_key", "product_key", F.col("rank").alias("at")), "query_key").join(known, "product_key")
    order = Window.partitionBy("query_id").orderBy("at", F.desc("seen"), "product_key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("product_key").alias("doc"), "rank")


def with_products(hits: DataFrame, products: DataFrame, key_col: str = "record_key") -> DataFrame:
    """Hits with the columns of their products; hits whose product is gone are left out."""
    return hits.join(products.withColumnRenamed(key_col, "doc"), "doc")


def search_index(
    queries: DataFrame, ranks: DataFrame, products: DataFrame, postings: DataFrame, aliases: DataFrame, k: int, key_col: str = "record_key", time_col: str = "last_seen_at", members: DataFrame | None = None
) -> DataFrame:
    """R4 over the index: ``(query_id, doc, tier, rank)``: mapped products, then for a query and each alias of the brands it
    touches (J7) the best by BM25, then those whose search text holds it, the ones seen last first.

    ``products`` has ``search_text``; ``postings`` are those of :func:`product_postings`, or of
    :func:`head_postings` with their ``members``. Equal texts of several queries are searched once. A candidate gives at most ``2 k``
    hits to each method, which is enough: fewer than ``k`` of them can be mapped already.
    """
    queries = stored(queries, "queries")
    mapped = mapped_hits(queries, ranks, products, k, key_col, time_col)
    keyed = aliases.select(search_key(F.col("alias")).alias("alias_key"), "alias", "official_en").where(F.col("alias_key") != "")
    spoken = stored(expand_aliases(queries, keyed), "spoken")
    texts = spoken.select(F.col("query").alias("query_id"), "query").distinct()
    seen = products.select(F.col(key_col).alias("doc"), F.col(time_col).alias("seen"))
    full = search_bm25(texts, postings, 2 * k, seen, members).select("query_id", "doc", "rank", F.lit(0).alias("method"))
    part = search_substring(texts, products, 2 * k, key_col, "search_text", (time_col,)).select("query_id", "doc", "rank", F.lit(1).alias("method"))
    found = full.unionByName(part).withColumnRenamed("query_id", "query")
    return search_tiers(mapped, spoken.join(found, "query").select("query_id", "candidate", "method", "doc", "rank"), k)


def expand_queries(queries: DataFrame, aliases: DataFrame, related: DataFrame, most: int = 12) -> DataFrame:
    """``(query_id, candidate, query)``: the texts that a query is collected and searched by, in order, each key (K2) once.

    ``queries`` has ``query_id, query``, the ``brand`` asked for (or null), and of a recognized brand ``official_en`` and the
    ``matched`` text (or null). Order: every name of the brand with the rest of the query and with its compact form (or
    alone where there is no rest); the query and ``most`` aliases of brands it touches, where no brand is recognized; the
    rest and its aliases; the compact rest; related queries that ``related (entry, terms)`` lists; the brand's names.
    Without any candidate the query stays as it is. Null queries are empty ones.
    """
    none = F.array().cast("array<string>")
    met = F.col("official_en").isNotNull()
    base = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), clean_text(F.col("brand")).alias("brand"), "official_en", "matched")
    base = base.withColumn("rest", F.when(met, without_brand(F.col("query"), F.col("matched"))).otherwise(F.col("query")))
    base = base.withColumn("short", token_classes(F.col("rest"))["compact"])
    keyed = aliases.select(search_key(F.col("alias")).alias("alias_key"), "alias", "official_en").where(F.col("alias_key") != "")

    def touched(column: str, name: str) -> DataFrame:
        asked = base.select(F.col(column).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
        spoken = expand_aliases(asked, keyed, wide=True).where(F.col("candidate").between(1, most))
        return spoken.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("candidate", "query")))["query"].alias(name)).withColumnRenamed("query_id", column)

    asked = F.coalesce(F.nullif(F.col("rest"), F.lit("")), F.col("query"))
    listed = related.select(search_key(F.col("entry")).alias("entry_key"), F.col("terms").alias("related")).where(F.col("entry_key") != "")
    rows = base.join(touched("query", "whole_aliases"), "query", "left").join(touched("rest", "rest_aliases"), "rest", "left")
    rows = rows.join(alias_lists(aliases), "official_en", "left").withColumn("entry_key", search_key(asked)).join(listed, "entry_key", "left")
    brands = F.when(met, F.coalesce("spoken", F.array("matched"))).when(F.col("brand").isNotNull(), F.array("brand")).otherwise(none)
    rows = rows.withColumn("brands", brands)
    has_rest, has_short = F.coalesce(F.col("rest") != "", F.lit(False)), (F.col("short") != "") & (F.col("short") != F.col("rest"))
    paired = F.flatten(F.transform("brands", lambda b: F.when(has_short, F.array(F.concat_ws(" ", b, "rest"), F.concat_ws(" ", b, "short"))).otherwise(F.array(F.concat_ws(" ", b, "rest")))))
    candidates = F.concat(
        F.when(has_rest, paired).otherwise(F.col("brands")),
        F.when(met, none).otherwise(F.concat(F.array("query"), F.coalesce("whole_aliases", none))),
        F.when(has_rest, F.concat(F.array("rest"), F.coalesce("rest_aliases", none))).otherwise(none),
        F.when(has_short, F.array("short")).otherwise(none), F.coalesce("related", none), F.col("brands"),
    )
    pairs = F.filter(F.transform(candidates, lambda t: F.struct(clean_text(t).alias("text"), service_key(t).alias("key"))), lambda p: p["key"] != "")
    once = let(pairs, lambda p: F.transform(F.array_distinct(p["key"]), lambda k: F.element_at(p["text"], F.array_position(p["key"], k).cast("int"))))
    rows = rows.select("query_id", "query", once.alias("texts"))
    texts = F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.array("query"))
    return rows.select("query_id", F.posexplode(texts).alias("candidate", "query"))


def search_ladder(expanded: DataFrame, hits: DataFrame, products: DataFrame, limit: int, key_col: str = "record_key", group_col: str = "collection_key") -> DataFrame:
    """``(query_id, no, key, candidate, rank, doc)``: what the expansions of a query find, in order, grouped by ``group_col``.

    ``expanded`` has ``query_id, candidate, query, discovery``; ``hits`` are :func:`search_index` of the distinct texts, by
    text. Queries that are not for discovery take mapped products only, unless they have none. Expansions after the one
    that completes ``limit`` groups are not used. ``no`` numbers the groups by first place; the rows of one are those that
    :func:`quillmart.operators.upsert.merge_records` folds by (candidate, rank).
    """
    by_query = Window.partitionBy("query_id")
    found = expanded.join(hits.withColumnRenamed("query_id", "query"), "query").select("query_id", "candidate", "rank", "doc", "tier", "discovery")
    found = found.withColumn("mapped", F.max((F.col("tier") == 0).cast("int")).over(by_query) == 1)
    used = found.where(F.col("discovery") | ~F.col("mapped") | (F.col("tier") == 0)).select("query_id", "candidate", "rank", "doc")
    rows = used.join(products.select(F.col(key_col).alias("doc"), F.col(group_col).alias("key")), "doc")
    groups = rows.groupBy("query_id", "key").agg(F.min(F.struct("candidate", "rank")).alias("place"))
    groups = groups.withColumn("no", F.row_number().over(by_query.orderBy("place", "key"))).where(F.col("no") <= limit)
    groups = groups.withColumn("last", F.max(F.when(F.col("no") == limit, F.col("place.candidate"))).over(by_query))
    members = rows.join(groups.drop("place"), ["query_id", "key"])
    return members.where(F.col("last").isNull() | (F.col("candidate") <= F.col("last"))).select("query_id", "no", "key", "candidate", "rank", "doc")


def autocomplete(prefixes: DataFrame, hits: DataFrame, products: DataFrame, limit: int, values: tuple[str, ...] = ("source_brand_name", "product_name_ko", "category"), key_col: str = "record_key") -> DataFrame:
    """``(prefix_id, rank, text)``: values of the hits of a prefix whose key holds the prefix's key, each key once.

    ``prefixes`` has ``prefix_id, prefix``; ``hits`` are ``(query_id, doc, rank)`` of the prefixes, best first.
    """
    asked = prefixes.select("prefix_id", search_key(F.col("prefix")).alias("prefix_key")).where(F.col("prefix_key") != "")
    known = products.select(F.col(key_col).alias("doc"), F.array(*values).alias("values"))
    rows = hits.select(F.col("query_id").alias("prefix_id"), "doc", "rank").join(known, "doc").select("prefix_id", "rank", F.posexplode("values").alias("field", "value"))
    rows = rows.withColumns({"text": clean_text(F.col("value")), "key": search_key(F.col("value"))}).join(asked, "prefix_id").where((F.col("key") != "") & F.contains("key", "prefix_key"))
    once = rows.groupBy("prefix_id", "key").agg(F.min(F.struct("rank", "field", "text")).alias("first"))
    order = Window.partitionBy("prefix_id").orderBy("first")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("prefix_id", "rank", F.col("first.text").alias("text"))


def lines_of(texts: DataFrame, limit: int) -> DataFrame:
    """``(text_id, line_no, line)``: the first ``limit`` lines of each pasted text."""
    return texts.select("text_id", F.posexplode(F.slice(batch_lines(F.col("text")), 1, limit)).alias("line_no", "line")).where(F.col("line") != "")


def search_lines(lines: DataFrame, hits: DataFrame, products: DataFrame, haystack: list[str], key_col: str = "record_key") -> DataFrame:
    """``(text_id, line_no, line, doc, match_score)``: for each line the best hit that matches it strictly (R8); lines without one go.

    ``hits`` are :func:`search_index` of the distinct lines, by text; ``products`` has the ``haystack``, ``quality_score`` and
    ``source_priority``.
    """
    known = products.select(F.col(key_col).alias("doc"), *haystack, "quality_score", "source_priority")
    pairs = hits.select("query_id", "doc", F.col("rank").alias("index")).join(known, "doc").withColumn("product_query", F.col("query_id"))
    ranked = rank_matches(match_scores(pairs, haystack), strict_only=True)
    best = ranked.where((F.col("rank") == 1) & (F.col("match_score") > 0)).select(F.col("query_id").alias("line"), "doc", "match_score")
    return lines.join(best, "line").select("text_id", "line_no", "line", "doc", "match_score")
