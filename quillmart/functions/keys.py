"""Keys that records, products, offers and matches are told apart by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmart.functions.text import let, search_key, service_key

#: Label, priority and kind of known sources.
SOURCE_PROFILES: tuple[tuple[str, str, int, str], ...] = (
    ("oliveyoung", "Olive Young", 10, "retailer"),
    ("oliveyoung-global", "Olive Young Global", 15, "retailer"),
    ("musinsa", "Musinsa", 30, "retailer"),
    ("coupang", "Coupang", 35, "retailer"),
    ("hwahae", "Hwahae", 45, "catalog"),
    ("glowpick", "Glowpick", 46, "catalog"),
    ("fudejapan", "Fude Japan", 47, "catalog"),
    ("official", "Official brand", 20, "brand"),
    ("managed", "Managed scraper", 40, "managed"),
    ("barcode", "Barcode/GTIN", 50, "catalog"),
    ("discovery", "Discovery API", 60, "discovery"),
    ("external", "External source", 90, "external"),
)
DEFAULT_PRIORITY = 1000


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _named(key, brand: Column, name: Column, prefix: str = "") -> Column:
    """Brand and name keys joined, null where one of them is empty; each key is computed once."""
    both = F.struct(key(brand).alias("b"), key(name).alias("n"))
    return let(both, lambda k: F.when((k["b"] != "") & (k["n"] != ""), F.concat(F.lit(prefix), k["b"], F.lit(":"), k["n"])))


def index_record_key(source: Column, product_id: Column, brand: Column, name: Column, url: Column, made: bool = False) -> Column:
    """K7: products of the index. Where the keys of texts have been ``made`` before, brand and name are their search keys."""
    primary = _filled(product_id) & (F.substring_index(source, ":", 1) == "oliveyoung")
    own = F.coalesce(
        _named((lambda c: F.coalesce(c, F.lit(""))) if made else search_key, brand, name, "product:"),
        F.when(_filled(product_id), F.concat(source, F.lit(":"), product_id)).otherwise(F.concat(source, F.lit(":"), search_key(url))),
    )
    return F.when(primary, F.concat(F.lit("oliveyoung:"), product_id)).otherwise(own)


def collection_record_key(source: Column, product_id: Column, brand: Column, name: Column, url: Column) -> Column:
    """K8: records of one collection."""
    return (
        F.when(_filled(product_id), F.concat(source, F.lit(":"), product_id))
        .when(service_key(url) != "", F.concat(source, F.lit(":"), service_key(url)))
        .when(_named(service_key, brand, name).isNotNull(), F.concat(source, F.lit(":product:"), _named(service_key, brand, name)))
        .otherwise(F.concat(source, F.lit(":"), service_key(name)))
    )


def pipeline_record_key(source: Column, product_id: Column, brand: Column, name: Column, url: Column) -> Column:
    """K9: records of one ingestion query."""
    return (
        F.when(_filled(product_id), F.concat(source, F.lit(":"), product_id))
        .when(_named(search_key, brand, name).isNotNull(), _named(search_key, brand, name))
        .otherwise(search_key(url))
    )


def document_id(source: Column, product_id: Column, brand: Column, name: Column, url: Column) -> Column:
    """Search documents."""
    return (
        F.when(_filled(product_id), F.concat(source, F.lit(":"), product_id))
        .when(_filled(brand) & _filled(name), F.concat(source, F.lit(":"), brand, F.lit(":"), name))
        .otherwise(F.concat(source, F.lit(":"), F.coalesce(url, F.lit(""))))
    )


def catalog_key(source: Column, product_id: Column, url: Column, canonical: Column, brand: Column, name: Column) -> Column:
    """Rows of a catalog file."""
    known = F.concat_ws(":", *(F.nullif(c, F.lit("")) for c in (source, canonical, brand, name)))
    return F.when(_filled(product_id), F.concat(source, F.lit(":"), product_id)).when(_filled(url), F.concat(source, F.lit(":"), url)).otherwise(known)


def target_key(field: Column, canonical: Column, source: Column, product_id: Column, display: Column) -> Column:
    """Enrichment targets; one for all sources where the English name of a canonical product is wanted."""
    of_product = F.when(field == "product_name_en", F.concat_ws(":", field, canonical)).otherwise(F.concat_ws(":", field, canonical, source))
    return F.when(_filled(canonical), of_product).otherwise(F.concat(field, F.lit(":"), F.concat_ws(":", *(F.nullif(c, F.lit("")) for c in (source, product_id, display)))))


def product_merge_key(canonical: Column, brand_en: Column, brand_ko: Column, name: Column, made: bool = False) -> Column:
    """Products that are one; null for those that are never merged. Where keys have been ``made`` before, the columns are
    service keys."""
    key = (lambda c: F.coalesce(c, F.lit(""))) if made else service_key
    brand = F.coalesce(F.nullif(key(brand_en), F.lit("")), key(brand_ko))
    return F.when(key(canonical) != "", F.concat(F.lit("canonical:"), key(canonical))).when((brand != "") & (key(name) != ""), F.concat(brand, F.lit(":"), key(name)))


def offer_key(source: Column, product_id: Column, url: Column) -> Column:
    """K13."""
    return F.concat(source, F.lit(":"), F.when(_filled(product_id), product_id).otherwise(url))


def match_id(canonical: Column, source: Column, product_id: Column) -> Column:
    """K14."""
    return F.concat(F.lit("match:"), canonical, F.lit(":"), source, F.lit(":"), product_id)


def job_kind(c: Column) -> Column:
    """A clean kind of job: lower case, other characters than letters, digits, ``:`` ``_`` ``-`` become one hyphen."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^0-9a-z가-힣:_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "-+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("oliveyoung-search"))


def job_key(kind: Column, query: Column) -> Column:
    """K15."""
    return F.concat(job_kind(kind), F.lit(":"), search_key(query))


def _profile(source: Column, place: int, otherwise: Column) -> Column:
    """A property of the source profile: that of the part before the first colon."""
    family = F.substring_index(F.trim(source), ":", 1)
    entries = [F.lit(x) for p in SOURCE_PROFILES for x in (p[0], p[place])]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.coalesce(family, F.lit(""))), otherwise)


def source_label(source: Column) -> Column:
    """F25."""
    return _profile(source, 1, F.nullif(F.trim(source), F.lit("")))


def source_priority(source: Column) -> Column:
    """smaller is better; unknown sources come last."""
    return _profile(source, 2, F.lit(DEFAULT_PRIORITY))


def source_kind(source: Column) -> Column:
    """F25; null for unknown sources."""
    return _profile(source, 3, F.lit(None).cast("string"))


def source_allowed(source: Column, prefixes: list[str]) -> Column:
    """Whether a source is one of the prefixes or a variant of one; without prefixes every source is allowed."""
    clean = [p.strip() for p in prefixes if p and p.strip()]
    if not clean:
        return F.lit(True)
    return F.coalesce(F.trim(source).isin(*clean), F.lit(False)) | F.coalesce(F.exists(F.array(*map(F.lit, clean)), lambda p: F.trim(source).startswith(F.concat(p, F.lit(":")))), F.lit(False))
