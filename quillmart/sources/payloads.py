"""API payloads to source records. A payload is JSON text; a field is the first of several keys that has a value.

Payloads are never inferred: their items are taken as text, each item as a map from key to text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.functions.text import brand_from_name, clean_text, has_hangul, has_latin, let, parse_krw_price, payload_float, payload_int, sold_out_from_status
from quillmart.sources.tables import assert_record_schema

#: Keys under which lists of items stand, and the candidate keys of each field of a generic payload.
LIST_KEYS = ("products", "items", "results", "data")
GENERIC_KEYS: dict[str, tuple[str, ...]] = {
    "brand": ("brand_ko", "brandKo", "brand", "brandName", "brand_name"),
    "brand_en": ("brand_en", "brandEn", "brandNameEn", "brand_name_en"),
    "name": ("product_name_ko", "productNameKo", "productName", "name", "title"),
    "name_en": ("product_name_en", "productNameEn", "englishProductName", "nameEn", "titleEn"),
    "category": ("category", "categoryName", "category_name", "categories"),
    "image": ("image_url", "imageUrl", "image", "thumbnail"),
    "url": ("source_url", "sourceUrl", "url", "productUrl", "link"),
    "id": ("source_product_id", "productId", "goodsNo", "id", "gtin", "barcode"),
    "price": ("price", "regular_price", "regularPrice"),
    "original_price": ("original_price", "originalPrice"),
    "sale_price": ("sale_price", "salePrice"),
    "discount_rate": ("discount_rate", "discountRate"),
    "shade": ("shade", "color", "option", "optionName"),
    "currency": ("currency",),
    "options": ("options", "optionNames", "variants"),
    "rating": ("rating", "avgRating", "reviewScore"),
    "review_count": ("review_count", "reviewCount", "reviewsCount"),
    "description": ("description", "summary", "desc"),
    "updated_at": ("updated_at", "updatedAt", "lastUpdatedAt"),
}
OPTION_KEYS = ("name", "optionName", "option_name", "title", "color")
NO_OPTION = ("default title", "기본", "단품")


def first_value(item: Column, keys: Sequence[str]) -> Column:
    """The first value among ``keys`` of a map of texts that is neither missing nor empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(item, F.lit(k)), F.lit("")) for k in keys))


def items_of(payload: Column, keys: Sequence[str] = LIST_KEYS) -> Column:
    """The items of a payload as texts, however deep they are: the payload itself if it is a list; of an object what stands
    under the first of ``keys`` that leads to items. A list under a key ends the search in its object, an empty one too;
    objects under the keys before it are searched first. Null without items.

    The search is a fold over a stack of JSON texts. It visits the payload and values under ``keys`` alone, so it takes as
    many steps as the payload has such keys, and one. A string that holds JSON counts as what it holds.
    """
    none = F.array().cast("array<string>")

    def is_list(t: Column) -> Column:
        return F.ltrim(t).startswith("[")

    def children(t: Column) -> Column:
        values = F.filter(F.array(*(F.get_json_object(t, f"$.{k}") for k in keys)), lambda v: F.coalesce(F.ltrim(v).rlike(r"^[\[{]"), F.lit(False)))

        def upto(v: Column) -> Column:
            first = F.array_position(F.transform(v, is_list), True)
            return F.when(first == 0, v).otherwise(F.slice(v, F.lit(1), F.greatest(first.cast("int"), F.lit(1))))

        return let(values, upto)

    def visit(state: Column, _: Column) -> Column:
        def of(top: Column) -> Column:
            rest = F.slice(state["stack"], F.lit(2), F.size(state["stack"]))
            items = F.when(is_list(top), F.from_json(top, "array<string>"))
            found = F.when(F.size(items) > 0, items)
            return F.struct(F.when(is_list(top), rest).otherwise(F.concat(children(top), rest)).alias("stack"), found.alias("found"))

        idle = state["found"].isNotNull() | (F.size(state["stack"]) == 0)
        return F.when(idle, state).otherwise(let(F.element_at(state["stack"], 1), of))

    start = F.struct(F.array(payload).alias("stack"), F.lit(None).cast("array<string>").alias("found"))
    steps = F.size(F.split(payload, '"(?:' + "|".join(map(re.escape, keys)) + ')"'))
    return F.when(payload.isNotNull(), F.reduce(F.sequence(F.lit(1), steps), start, visit)["found"])


def exploded(payloads: DataFrame, payload_col: str, keys: Sequence[str] = LIST_KEYS, limit: int | None = None) -> DataFrame:
    """One row for each item: ``item``, a map from key to text. Items that aren't objects are left out."""
    items = items_of(F.col(payload_col), keys)
    rows = payloads.select(F.explode(items if limit is None else F.slice(items, 1, limit)).alias("text"))
    return rows.where(F.ltrim("text").startswith("{")).select(F.from_json("text", "map<string,string>").alias("item")).where(F.col("item").isNotNull())


def option_list(text: Column) -> Column:
    """Options of a payload: a text alone, or a list of texts and of objects with a name; each once."""
    one = F.when(clean_text(text).isNotNull(), F.array(clean_text(text)))
    listed = F.transform(F.from_json(text, "array<string>"), lambda t: F.when(t.startswith("{"), clean_text(first_value(F.from_json(t, "map<string,string>"), OPTION_KEYS))).otherwise(clean_text(t)))
    many = F.array_distinct(F.filter(listed, lambda t: t.isNotNull()))
    return F.when(text.startswith("["), F.when(F.size(many) > 0, many)).otherwise(one)


def sold_out(item: Column, out_keys: Sequence[str], in_keys: Sequence[str], status_keys: Sequence[str] = ()) -> Column:
    """Sold out by a flag, by the opposite of an in-stock flag, or by status words."""
    flag, stock = first_value(item, out_keys), first_value(item, in_keys)
    by_status = sold_out_from_status(first_value(item, status_keys)) if status_keys else F.lit(None).cast("boolean")
    return F.when(flag.isin("true", "false"), flag == "true").when(stock.isin("true", "false"), stock == "false").otherwise(by_status)


def category_text(text: Column) -> Column:
    """A category, or the parts of a category list joined by ``>``."""
    parts = F.filter(F.from_json(text, "array<string>"), lambda t: F.coalesce(t, F.lit("")) != "")
    return clean_text(F.when(text.startswith("["), F.array_join(parts, " > ")).otherwise(text))


def _known(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNotNull()
    return out


def map_json_payload(payloads: DataFrame, source: str, payload_col: str = "payload", limit: int | None = None, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Records of generic payloads; items without brand, name, image, URL, id and price are left out.

    The regular price is the price, else the sale price, else the original price; zero counts as missing in that choice.
    """
    item, k = F.col("item"), GENERIC_KEYS | (keys or {})
    field = lambda n: first_value(item, k[n])
    price, original, sale = (parse_krw_price(field(n)).cast("double") for n in ("price", "original_price", "sale_price"))
    zero = F.lit(0.0)
    rows = exploded(payloads, payload_col, limit=limit).where(_known(*(field(n) for n in ("brand", "name", "image", "url", "id")), price, original, sale))
    return assert_record_schema(rows.select(
        clean_text(field("brand")).alias("source_brand_name"), clean_text(field("brand_en")).alias("source_brand_name_en"), clean_text(field("name")).alias("product_name_ko"),
        clean_text(field("name_en")).alias("product_name_en"), category_text(field("category")).alias("category"), F.coalesce(F.nullif(price, zero), F.nullif(sale, zero), original).alias("regular_price"),
        original.alias("original_price"), sale.alias("sale_price"), payload_int(field("discount_rate")).alias("discount_rate"), payload_float(field("rating")).alias("rating"),
        payload_int(field("review_count")).alias("review_count"), F.coalesce(clean_text(field("currency")), F.lit("KRW")).alias("currency"), clean_text(field("shade")).alias("shade"),
        clean_text(field("description")).alias("description"), option_list(field("options")).alias("options"),
        sold_out(item, ("sold_out", "soldOut", "outOfStock"), ("in_stock", "inStock", "available"), ("stockStatus", "availability", "status")).alias("sold_out"),
        clean_text(field("image")).alias("image_url"), F.lit(source).alias("source"), clean_text(field("url")).alias("source_url"), clean_text(field("id")).alias("source_product_id"),
        clean_text(field("updated_at")).alias("updated_at"),
    ))


def map_scraper_payload(payloads: DataFrame, source: str = "managed", payload_col: str = "payload") -> DataFrame:
    """Records of a scraper's dataset, which names its fields in camel case first."""
    return map_json_payload(payloads, source, payload_col, keys={"description": ("description", "summary"), "review_count": ("reviewCount", "review_count"), "updated_at": ("updatedAt", "updated_at")})


def map_retailer_a_payload(payloads: DataFrame, base_url: str, payload_col: str = "payload") -> DataFrame:
    """There is a sale only with a discount rate above zero and a price to pay below the original price; the brand is the
    first word of the name after its badges; the URL is made of the id."""
    item = F.col("item")
    field = lambda *names: first_value(item, names)
    number, name, image = clean_text(field("goodsNumber", "goodsNo")), clean_text(field("goodsName", "productName")), clean_text(field("imageUrl"))
    original, pay, rate = parse_krw_price(field("originalPrice")).cast("double"), parse_krw_price(field("priceToPay")).cast("double"), payload_int(field("discountRate"))
    discounted = F.coalesce((rate > 0) & (pay < original), F.lit(False))
    sale = F.when(discounted, pay)
    rows = exploded(payloads, payload_col, ("data", "goodsList", "items", "products", "list")).where(_known(number, name, image, original, pay))
    return assert_record_schema(rows.select(
        brand_from_name(name).alias("source_brand_name"), clean_text(field("brandNameEn", "brand_en", "brandEn")).alias("source_brand_name_en"), name.alias("product_name_ko"),
        clean_text(field("goodsNameEn", "productNameEn", "nameEn")).alias("product_name_en"), clean_text(field("category", "categoryName", "categoryFullName", "displayCategory", "dispCatNm")).alias("category"),
        F.coalesce(sale, F.nullif(pay, F.lit(0.0)), original).alias("regular_price"), original.alias("original_price"), sale.alias("sale_price"), F.when(discounted, rate).alias("discount_rate"),
        payload_float(field("rating", "avgRating", "reviewScore")).alias("rating"), payload_int(field("reviewCount", "reviewsCount", "reviewCnt")).alias("review_count"), F.lit("KRW").alias("currency"),
        clean_text(field("description", "summary", "goodsDescription", "goodsDesc")).alias("description"), option_list(field("options", "optionNames", "variants", "items")).alias("options"),
        sold_out(item, ("soldOut", "sold_out", "outOfStock"), ("inStock", "in_stock", "available"), ("stockStatus", "availability", "status")).alias("sold_out"), image.alias("image_url"),
        F.lit("oliveyoung").alias("source"), F.concat(F.lit(base_url.rstrip("/") + "/store/goods/getGoodsDetail.do?goodsNo="), number).alias("source_url"), number.alias("source_product_id"),
        clean_text(field("updatedAt", "updated_at", "lastUpdatedAt")).alias("updated_at"),
    ))


def map_retailer_b_payload(payloads: DataFrame, product_url: str, payload_col: str = "payload") -> DataFrame:
    """A sale price that isn't below the normal price is none; brand and category may be nested objects.

    ``product_url`` is the URL before the product's number.
    """
    item = F.col("item")
    field = lambda *names: first_value(item, names)
    inside = lambda name, *names: first_value(F.from_json(F.try_element_at(item, F.lit(name)), "map<string,string>"), names)
    number, name, image = field("goodsNo", "goodsNumber", "id"), clean_text(field("goodsName", "productName", "name")), clean_text(field("imageUrl", "image", "thumbnail"))
    normal, cut = parse_krw_price(field("normalPrice", "originalPrice")).cast("double"), parse_krw_price(field("salePrice", "discountPrice")).cast("double")
    sale = F.when(F.coalesce(cut < normal, F.lit(True)), cut)
    url = F.when(number.isNotNull(), F.concat(F.lit(product_url), number)).otherwise(clean_text(field("goodsUrl", "url", "link")))
    plain = F.when(~field("category").startswith("{"), field("category"))
    rows = exploded(payloads, payload_col, ("data", "list", "goodsList", "items", "products", "results")).where(_known(name, image, url, normal))
    return assert_record_schema(rows.select(
        clean_text(F.coalesce(field("brandName"), inside("brand", "brandName"))).alias("source_brand_name"), clean_text(F.coalesce(field("brandNameEn"), inside("brand", "brandNameEn"))).alias("source_brand_name_en"),
        name.alias("product_name_ko"), clean_text(F.coalesce(plain, field("categoryName"), inside("category", "categoryName"))).alias("category"), F.coalesce(sale, normal).alias("regular_price"),
        normal.alias("original_price"), sale.alias("sale_price"), payload_float(field("rating", "avgRating")).alias("rating"), payload_int(field("reviewCount", "reviewCnt")).alias("review_count"),
        F.lit("KRW").alias("currency"), image.alias("image_url"), F.lit("musinsa").alias("source"), url.alias("source_url"), number.alias("source_product_id"),
        sold_out(item, ("isSoldOut", "soldOut", "outOfStock"), ("isOnSale", "inStock", "available")).alias("sold_out"),
    ))


def map_storefront_payload(payloads: DataFrame, domain: str, official: str, keyword: str | None = None, payload_col: str = "payload") -> DataFrame:
    """The first ten variants are folded in order: the first price, unless one has a higher price to compare with, which
    then is the price and that variant's the sale price; titles of variants are options. Hangul titles are Korean names."""
    item = F.col("item")
    field = lambda *names: first_value(item, names)
    amount = lambda text: F.when(F.replace(text, F.lit(","), F.lit("")).try_cast("double") > 0, F.replace(text, F.lit(","), F.lit("")).try_cast("double"))
    variants = F.slice(F.from_json(F.try_element_at(item, F.lit("variants")), "array<struct<price:string,compare_at_price:string,title:string>>"), 1, 10)
    folded = F.aggregate(
        F.coalesce(variants, F.array().cast("array<struct<price:string,compare_at_price:string,title:string>>")),
        F.struct(F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("sale")),
        lambda acc, v: let(
            F.struct(amount(v["price"]).alias("p"), amount(v["compare_at_price"]).alias("c")),
            lambda x: F.when((x["c"] > x["p"]) & acc["sale"].isNull(), F.struct(x["c"].alias("price"), x["p"].alias("sale"))).otherwise(F.struct(F.coalesce(acc["price"], x["p"]).alias("price"), acc["sale"].alias("sale"))),
        ),
    )
    options = F.filter(F.transform(variants, lambda v: clean_text(v["title"])), lambda t: t.isNotNull() & ~F.lower(t).isin(*NO_OPTION))
    title, handle = clean_text(field("title")), clean_text(field("handle"))
    image = clean_text(F.get_json_object(F.try_element_at(item, F.lit("images")), "$[0].src"))
    rows = exploded(payloads, payload_col, ("products",))
    if keyword:
        low = F.lit(keyword.lower())
        rows = rows.where(F.contains(F.lower(F.coalesce(field("title"), F.lit(""))), low) | F.contains(F.lower(F.coalesce(field("vendor"), F.lit(""))), low))
    return assert_record_schema(rows.withColumn("f", folded).select(
        F.lit(official).alias("source_brand_name"), F.lit(official).alias("source_brand_name_en"), F.when(has_hangul(title), title).alias("product_name_ko"),
        F.when(has_latin(title) & ~has_hangul(title), title).alias("product_name_en"), clean_text(field("product_type")).alias("category"), F.floor("f.price").cast("double").alias("regular_price"),
        F.floor("f.price").cast("double").alias("original_price"), F.floor("f.sale").cast("double").alias("sale_price"), F.lit("KRW").alias("currency"), F.when(F.size(options) > 0, options).alias("options"),
        image.alias("image_url"), F.lit("official").alias("source"), F.concat(F.lit(f"https://{domain}"), F.coalesce(F.concat(F.lit("/products/"), handle), F.lit(""))).alias("source_url"), field("id").alias("source_product_id"),
    ))
