"""Whether a product answers a query: token classes, query classes, match scores, and search of a verified catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.keys import DEFAULT_PRIORITY
from quillmart.functions.text import clean_text, let, service_key, service_key_of
from quillmart.shared import once_for_each

#: Words that name a category, words that name a colour, and single words that ask for discovery.
CATEGORY_WORDS = (
    "패드", "컨실러", "섀딩", "쉐딩", "파우더", "브로우", "브로우카라", "브러시", "팔레트", "틴트", "라이너", "밤", "젤", "오일", "크림", "로션", "스프레이", "토너", "세럼", "앰플", "에센스",
    "클렌저", "클렌징", "샴푸", "트리트먼트", "마스크", "팩", "쿠션", "네일",
)
COLOR_WORDS = (
    "베이지", "브라운", "초코", "그레이", "쿨", "웜", "피치", "핑크", "로즈", "레드", "코랄", "오렌지", "스톤", "클리어", "누드", "블랙", "화이트", "gray", "grey", "brown", "pink", "peach",
)
DISCOVERY_WORDS = (
    "각질", "광채", "미백", "모공", "보습", "브라이트닝", "수분", "장벽", "진정", "탄력", "피지", "쿨링", "세럼", "에센스", "앰플", "토너", "스킨", "크림", "수분크림", "아이크림", "슬리핑팩",
    "클렌저", "클렌징", "폼클렌저", "마스크팩", "시트마스크", "필링젤", "미스트", "오일", "파운데이션", "쿠션", "비비크림", "CC크림", "프라이머", "컨실러", "블러셔", "블러시", "볼터치",
    "하이라이터", "섀딩", "마스카라", "아이라이너", "아이섀도", "아이섀도우", "눈썹", "브로우", "립스틱", "립밤", "자외선차단제", "선스틱", "선세럼", "로션", "바디로션",
)
#: Keys that a compact query leaves out.
COUNTERS = ("호", "번", "no", "m")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0))


def _has_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def token_classes(query: Column) -> Column:
    """``struct<key, tokens, category, distinctive, compact, strict>`` of a query.

    ``category`` are the category words in its key; ``distinctive`` its token keys of two characters or more that are
    neither category, number nor colour; ``compact`` the query without colours and counters; ``strict`` says whether a
    result must be relevant: two distinctive tokens, or one (or a colour) with a category.
    """
    categories = F.array(*(F.lit(service_key_of(w)) for w in CATEGORY_WORDS))

    def classify(x: Column) -> Column:
        category = F.filter(x["categories"], lambda w: F.contains(x["key"], w))
        plain = lambda p: (F.length(p["key"]) >= 2) & ~_has_any(p["key"], COLOR_WORDS)
        digits = lambda p: p["key"].rlike("^[0-9]+$")

        def finish(cat: Column) -> Column:
            distinctive = F.filter(x["pairs"], lambda p: plain(p) & ~F.array_contains(cat, p["key"]) & ~digits(p))
            compact = F.filter(x["pairs"], lambda p: plain(p) & ~p["key"].isin(*COUNTERS) & (F.array_contains(cat, p["key"]) | ~digits(p)))
            colored = F.exists(x["pairs"], lambda p: _has_any(p["key"], COLOR_WORDS))
            n = F.size(distinctive)
            return F.struct(
                x["key"].alias("key"), x["pairs"]["key"].alias("tokens"), cat.alias("category"), distinctive["key"].alias("distinctive"), F.coalesce(clean_text(F.array_join(compact["word"], " ")), F.lit("")).alias("compact"),
                ((n >= 2) | (((n > 0) | colored) & (F.size(cat) > 0))).alias("strict"),
            )

        return let(category, finish)

    pairs = F.transform(_words(query), lambda w: F.struct(service_key(w).alias("key"), w.alias("word")))
    return let(F.struct(service_key(query).alias("key"), pairs.alias("pairs"), categories.alias("categories")), classify)


def query_class(query: Column, brand_alias: Column, product_query: Column, has_related: Column) -> Column:
    """``brand`` (nothing but a brand), ``broad`` (one word with related queries), ``discovery`` (one word that asks for
    it), else ``ordinary``."""
    one = F.size(_words(query)) == 1
    asked = F.coalesce(F.nullif(product_query, F.lit("")), query)
    discovery = (F.size(_words(asked)) == 1) & service_key(F.element_at(_words(asked), 1)).isin(*DISCOVERY_WORDS)
    return (
        F.when(brand_alias.isNotNull() & clean_text(product_query).isNull(), "brand")
        .when(one & has_related, "broad")
        .when(discovery, "discovery")
        .otherwise("ordinary")
    )


def with_query_classes(queries: DataFrame) -> DataFrame:
    """Queries with what :func:`match_scores` needs of ``product_query``, made before they meet products."""
    return queries.withColumn("__q", token_classes(F.col("product_query")))


def with_haystack(products: DataFrame, haystack: list[str]) -> DataFrame:
    """Products with what :func:`match_scores` needs of them, made before they meet queries."""
    return products.withColumn("__h", service_key(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in haystack))))


def match_scores(pairs: DataFrame, haystack: list[str]) -> DataFrame:
    """Adds ``match_score`` to pairs of a query and a product; 0 is no match.

    A product must hold all category words of the query and its distinctive tokens (all but one of three or more, two of
    two). Then the whole query in it gives 100 and each token of two characters or more 10. ``haystack`` names the
    product's text columns; pairs also have ``product_query``.
    """
    rows = pairs if "__q" in pairs.columns else with_query_classes(pairs)
    rows = rows if "__h" in pairs.columns else with_haystack(rows, haystack)
    h, q = F.col("__h"), F.col("__q")
    within = lambda words: F.size(F.filter(words, lambda w: F.contains(h, w)))
    n = F.size(q["distinctive"])
    gate = (q["key"] != "") & (h != "") & (within(q["category"]) == F.size(q["category"]))
    gate = gate & F.when(n >= 2, within(q["distinctive"]) >= F.greatest(F.lit(2), n - 1)).when(n == 1, within(q["distinctive"]) == 1).otherwise(True)
    score = F.when(F.contains(h, q["key"]), 100).otherwise(0) + 10 * within(F.filter(q["tokens"], lambda t: F.length(t) >= 2))
    return rows.withColumn("match_score", F.when(gate, score).otherwise(0)).withColumn("strict", q["strict"]).drop("__q", "__h")


def rank_matches(scored: DataFrame, by_score: bool = True, strict_only: bool = False) -> DataFrame:
    """Matches of each ``query_id`` with their ``rank``: by score, quality, priority and place, or by quality and place.

    Where nothing matches, all results stay in their order, unless the query is strict (or ``strict_only``): then none.
    ``scored`` has ``query_id, match_score, quality_score, source_priority, index, strict``.
    """
    all_of = Window.partitionBy("query_id")
    top = F.max("match_score").over(all_of)
    lax = ~F.col("strict") & F.lit(not strict_only)
    kept = scored.withColumn("__top", top).where((F.col("match_score") > 0) | ((F.col("__top") <= 0) & lax))
    priority = F.coalesce("source_priority", F.lit(DEFAULT_PRIORITY))
    matched = F.col("__top") > 0
    quality = F.when(matched, -F.col("quality_score"))
    keys = [F.when(matched, -F.col("match_score")), quality, F.when(matched, priority), F.col("index")] if by_score else [quality, F.col("index")]
    return kept.withColumn("rank", F.row_number().over(all_of.orderBy(*keys))).drop("__top")


def search_catalog(queries: DataFrame, catalog: DataFrame, text_col: str, key_col: str, group_col: str) -> DataFrame:
    """``(query_id, key)`` of products that hold a query's key or all of its tokens, and of all products of their group.

    Distinct texts are looked up by the tokens' three-character grams through :func:`search.search_substring` for each token;
    those that all tokens find, or the whole key, match. Queries without tokens find nothing.
    """
    from quillmart.operators.search import search_substring

    rows = catalog.select(F.col(key_col).alias("doc"), F.col(group_col).alias("group"), F.col(text_col).alias("text"))
    rows = once_for_each(rows, {"text": F.col("text")}, {"search_text": service_key(F.col("text"))}).select("doc", "group", "search_text").distinct()
    texts = rows.select("search_text").distinct().withColumn("doc", F.col("search_text"))
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.transform(_words(F.col("query")), lambda w: service_key(w)), lambda t: t != ""))).alias("token"))
    words = tokens.select(F.col("token").alias("query_id"), F.col("token").alias("query")).distinct()
    by_token = search_substring(words, texts, 2**31 - 1, "doc", key=lambda k: k).select(F.col("query_id").alias("token"), "doc")
    need = tokens.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    every = tokens.join(by_token, "token").groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("met")).join(need, "query_id").where(F.col("met") == F.col("n"))
    whole = search_substring(queries.select("query_id", "query"), texts, 2**31 - 1, "doc", key=service_key)
    hits = every.select("query_id", "doc").unionByName(whole.select("query_id", "doc")).distinct().withColumnRenamed("doc", "search_text")
    grouped = rows.where(F.col("group").isNotNull()).select("search_text", "group").distinct()
    groups = hits.join(grouped, "search_text").select("query_id", "group").distinct()
    # A product of a group is found by its group, itself a mate; one without a group by its text. A key of several rows may
    # be found in more than one way, so it is told apart.
    marked = rows.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("doc")) > 1)

    def found(docs: DataFrame) -> DataFrame:
        mates = groups.join(docs.where(F.col("group").isNotNull()), "group").select("query_id", F.col("doc").alias("key"))
        alone = hits.join(docs.where(F.col("group").isNull()), "search_text").select("query_id", F.col("doc").alias("key"))
        return mates.unionByName(alone)

    return found(marked.where(~F.col("several"))).unionByName(found(marked.where("several")).distinct())
