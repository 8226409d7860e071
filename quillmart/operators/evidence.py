"""The evidence audit (A16): what the pages of enrichment targets offer for them, and why the rest is of no use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.functions.text import casefold, clean_text, is_positive_price, is_usable_image_url, latin_key, let, name_language

#: Fields that evidence can fill, marks of page titles that are no product's name, and what a word of a name is.
FIELDS = ("product_name_en", "image_url", "price")
TITLE_MARKS = ("store is unavailable", "something went wrong", "official shop", "official store", "homepage", "another me")
NAME_WORD = "[A-Za-z0-9™®']+"
#: Names that a row of the report shows.
SHOWN = 5
EVIDENCE = {"names": "array<struct<source:string,name:string>>", "images": "array<struct<source:string,url:string>>", "prices": "array<struct<source:string,price:string,currency:string>>"}


def is_weak_name(name: Column, rejected: Column) -> Column:
    """Whether a Latin name says too little: it is one of the ``rejected`` keys (an array), has a mark of a shop's title, is
    one word, or two words that begin with a rejected key."""
    words = F.size(F.regexp_extract_all(name, F.lit(NAME_WORD), F.lit(0)))
    folded = casefold(F.coalesce(name, F.lit("")))
    marked = F.exists(F.array(*map(F.lit, TITLE_MARKS)), lambda m: F.contains(folded, m))
    known = let(latin_key(name), lambda k: F.array_contains(rejected, k) | ((words <= 2) & F.exists(rejected, lambda r: F.startswith(k, r))))
    return clean_text(name).isNull() | known | marked | (words < 2)


def audit_targets(targets: DataFrame, evidence: DataFrame, on: str = "source_url") -> DataFrame:
    """Every target with the evidence of its page: ``candidate_name, candidate_language, candidate_source,
    candidate_image_url, candidate_price, candidate_currency``, ``usable`` (whether its field has a candidate), ``reason``,
    ``evidence_count, evidence_names, evidence_languages`` and ``error``.

    ``targets`` has ``field, source, brand_ko, brand_en`` and the page's URL; ``evidence`` has the URL once, ``names, images,
    prices`` as :func:`pages.page_evidence` gives them, and may have ``error``. The name is the first Latin one that is
    not weak (brands and source are rejected names), the price the first above zero, the image the first one, usable if
    its URL is whole. A target whose field has no candidate has a reason; one whose field has one keeps the reason for
    which the page has no name, if it has none. A URL that is not among the pages is ``not_crawled``; targets without URL
    have no evidence and no error. Rows stay as many as targets; columns of the names above are replaced.
    """
    made = ("candidate_name", "candidate_language", "candidate_source", "candidate_image_url", "candidate_price", "candidate_currency", "usable", "reason", "evidence_count", "evidence_names", "evidence_languages", "error")
    base = targets.drop(*made)
    error = F.col("error") if "error" in evidence.columns else F.lit(None)
    side = evidence.where(F.col(on).isNotNull()).select(F.col(on).alias("__url"), F.struct(*(F.col(n) for n in EVIDENCE), error.cast("string").alias("error"), F.lit(True).alias("crawled")).alias("__e"))
    joined = base.join(side, F.nullif(F.col(on), F.lit("")) == F.col("__url"), "left").drop("__url")

    none = {n: F.array().cast(t) for n, t in EVIDENCE.items()}
    names, images, prices = (F.coalesce(F.col(f"__e.{n}"), none[n]) for n in EVIDENCE)
    missing = F.when((F.coalesce(F.col(on), F.lit("")) != "") & F.col("__e.crawled").isNull(), "not_crawled")
    sources = F.array("brand_en", "brand_ko", "source", F.substring_index("source", ":", 1))
    rejected = F.transform(F.filter(sources, lambda s: clean_text(s).isNotNull()), latin_key)
    spoken = F.transform(names, lambda n: F.struct(n["source"].alias("source"), n["name"].alias("name"), name_language(n["name"]).alias("language")))
    known = joined.withColumns({"__names": spoken, "__images": images, "__prices": prices, "__rejected": rejected, "error": F.coalesce(F.nullif(F.col("__e.error"), F.lit("")), missing)})

    def first(array: str, test) -> Column:
        return F.try_element_at(F.filter(array, test), F.lit(1))

    known = known.withColumns({
        "__name": first("__names", lambda n: (n["language"] == "latin") & ~is_weak_name(n["name"], F.col("__rejected"))),
        "__image": F.try_element_at("__images", F.lit(1)),
        "__price": first("__prices", lambda p: is_positive_price(p["price"])),
        "__languages": F.array_distinct(F.filter(F.transform("__names", lambda n: n["language"]), lambda x: x != "unknown")),
    })
    empty = lambda n: F.size(n) == 0
    only = lambda *words: F.sort_array("__languages") == F.array(*map(F.lit, words))
    failed = F.col("error").isNotNull()
    name_reason = (
        F.when(F.col("__name").isNotNull(), "")
        .when(failed & empty("__names"), "fetch_error")
        .when(empty("__names"), "no_evidence")
        .when(F.array_contains("__languages", "latin"), "latin_evidence_rejected_low_confidence")
        .when(only("mixed"), "mixed_language_without_latin_product_name")
        .when(only("ko"), "korean_only_evidence")
        .otherwise("korean_or_mixed_evidence_only")
    )
    field = F.col("field")
    usable = F.when(field == "product_name_en", F.col("__name").isNotNull()).when(field == "image_url", F.coalesce(is_usable_image_url(F.col("__image.url")), F.lit(False))).when(field == "price", F.col("__price").isNotNull()).otherwise(False)
    own_reason = (
        F.when(failed & empty("__names") & empty("__images") & empty("__prices"), "fetch_error")
        .when(field == "image_url", F.when(empty("__images"), "no_image_evidence").otherwise("invalid_image_url_evidence"))
        .when(field == "price", F.when(empty("__prices"), "no_price_evidence").otherwise("non_positive_price_evidence"))
        .otherwise(name_reason)
    )
    shown = lambda what: F.array_join(F.transform(F.slice("__names", 1, SHOWN), lambda n: n[what]), " | ")
    return known.select(
        *base.columns,
        F.col("__name.name").alias("candidate_name"), F.col("__name.language").alias("candidate_language"), F.col("__name.source").alias("candidate_source"),
        F.col("__image.url").alias("candidate_image_url"), F.col("__price.price").alias("candidate_price"), F.col("__price.currency").alias("candidate_currency"),
        usable.alias("usable"), F.when(usable, name_reason).otherwise(own_reason).alias("reason"),
        F.size("__names").alias("evidence_count"), shown("name").alias("evidence_names"), shown("language").alias("evidence_languages"), "error",
    )
