"""Records of a retailer's listing and detail pages (S13, S14) and of product cards (S12), by one parse of each page.

What a page says of its products stands in linked data and page state (JSON), in script literals, in cards and in the
markup of a detail page. Python runs in Arrow batches, a page at a time; a page that says nothing gives no records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.text import OPTION_NOISE, PRODUCT_ID_HANDLER, PRODUCT_ID_URL, SHADE
from quillmart.sources.markup import Node, parsed

Record = dict[str, object]

# Where pages put things. Selectors, keys and attributes are tried in this order.
ITEMS = ("ul.cate_prd_list > li", "ul.prd_list > li", "li[data-ref-goodsno]", "li[data-goods-no]", "div.prd_info")
BRAND = (".tx_brand", ".prd_brand", "[data-qa-name='text-brand-name']", "[class*='brand']")
NAME = (
    "[data-qa-name='text-product-title']",
    "[class*='title-area'] h3",
    ".tx_name",
    ".prd_name .tx_name",
    ".prd_name",
    "[class*='goods-name']",
    "[class*='product-name']",
)
TITLE = ("[data-qa-name='text-product-title']", "[class*='title-area'] h3", ".prd_detail_box .prd_name", "p.prd_name", "h3", "h1")
LIST_PRICE = (
    "[data-qa-name='text-product-original-price']",
    "[class*='original-price']",
    ".prd_price .tx_org",
    ".price .tx_org",
    "[class*='price'] [class*='org']",
)
PRICE = (
    "[data-qa-name='text-product-discount-price']",
    "[data-qa-name='text-product-price']",
    "[class*='price-area'] [class*='price__']",
    ".prd_price .tx_cur",
    ".prd_price",
    ".price",
    "[class*='price']",
)
OPTIONS = (
    "select option",
    ".prd_option_box li",
    ".prd_option_box button",
    ".option_box li",
    ".option_box button",
    "[class*='option'] li",
    "[class*='option'] button",
)
CATEGORY = (".loc_history", ".breadcrumb", "[class*='breadcrumb']", "[class*='category']")
RATING = ("[class*='rating']", "[class*='score']", ".prd_point_area")
REVIEWS = ("[class*='review']", ".review_point", ".goods_reputation")
IMAGE_ATTRS = ("src", "data-src", "data-original", "data-lazy", "data-image-url", "data-img-url", "data-img-path")
ITEM_ATTRS = {
    "brand": ("data-brand-name", "data-brand-nm", "data-brnd-name", "data-brnd-nm", "data-onl-brnd-nm"),
    "name": ("data-goods-name", "data-goods-nm", "data-prd-name", "data-prdt-name", "data-product-name", "title", "aria-label"),
    "original": ("data-normal-price", "data-regular-price", "data-org-price", "data-nrml-amt"),
    "sale": ("data-sale-price", "data-price-to-pay", "data-current-price", "data-discount-price", "data-price"),
    "image": ("data-image-url", "data-img-url", "data-img-path", "data-thumb-url", "data-thumbnail"),
    "id": ("data-ref-goodsno", "data-ref-goods-no", "data-goods-no", "data-goodsno", "data-prd-no", "data-prdt-no"),
    "category": ("data-category", "data-category-name", "data-disp-cat-nm"),
}
KEYS = {
    "name": ("name", "productName", "goodsNm", "goodsName", "prdNm", "prdtName", "dispGoodsNm", "goodsFullNm", "onlineGoodsNm"),
    "brand": ("brand", "brandName", "brandNm", "brndNm", "onlBrndNm", "maker"),
    "image": ("image", "imageUrl", "imgUrl", "thumbnail", "goodsImg", "goodsImgUrl", "mainImgUrl", "imgPathNm", "thumbImgUrl"),
    "id": ("goodsNo", "goodsNumber", "goodsId", "productId", "prdtNo", "prdNo", "id"),
    "original": ("regularPrice", "normalPrice", "originalPrice", "nrmlAmt", "stdPrc", "orgPrice", "listPrice", "goodsPrc"),
    "sale": ("priceToPay", "salePrice", "discountPrice", "discountedPrice", "currentPrice", "finalPrice", "price"),
    "url": ("url", "link", "goodsUrl", "goodsDetailUrl", "productUrl"),
    "category": ("category", "categoryName", "categoryFullName", "dispCatNm", "displayCategory"),
    "discount": ("discountRate", "dcRate", "discount_rate"),
    "rating": ("ratingValue", "rating", "avgRating", "reviewScore"),
    "reviews": ("reviewCount", "reviewsCount", "reviewCnt", "ratingCount"),
    "shade": ("shade", "color", "optionName"),
    "description": ("description", "summary", "goodsDesc"),
    "options": ("options", "optionNames", "variants"),
    "gone": ("soldOut", "sold_out", "outOfStock"),
    "stock": ("availability", "stockStatus", "status"),
    "updated": ("updatedAt", "updated_at", "lastUpdatedAt"),
}
BRAND_KEYS, OPTION_KEYS = ("name", "brandName", "brandNm", "brndNm"), ("name", "optionName", "title", "color")
LITERAL_MARKS = ("goodsNo", "goodsNm", "goodsName", "prdtName")
LITERAL_NAMES = ("goodsNo", "goodsNm", "goodsName", "prdNm", "productName", "prdtName")
GONE_WORDS, GONE_STOCK, IN_STOCK = ("품절", "일시품절", "구매불가"), ("sold_out", "out_of_stock", "품절"), ("in_stock", "available", "판매중")
CARDS = ("li.xans-record-", "li[class*='item']", "li[class*='prd']", "li[class*='product']", "div[class*='product']", "div[class*='goods']", "div[class*='item']")
CARD_NAME = ("[class*='name']", "[class*='Name']", "[class*='title']", "[class*='Title']", ".description a", "a[title]")
CARD_PRICE = ("[class*='price']", "[class*='Price']", ".prd_price", ".sale", ".money", "li[rel*='판매가']")
CARD_OPTIONS = ("select option", "[class*='option'] li", "[class*='option'] button", "[class*='color'] li")
CARD_NOISE, CARD_NOISE_INSIDE = ("품절", "sold out", "soldout", "more", "view"), ("장바구니", "관심상품", "옵션", "선택")
CARD_IMAGE, CARD_LINK = ("src", "data-src", "data-original", "ec-data-src"), ("product", "goods", "item")
#: The path of a product's page, by its id.
PRODUCT_PATH = "/store/goods/getGoodsDetail.do?goodsNo="
#: Most options and shades of a detail page.
MOST_OPTIONS, MOST_SHADES = 30, 12

_HALF = re.compile("[\ud800-\udfff]")  # halves of characters, which no text may hold
_NUMBER = re.compile(r"\d[\d,]*")
_FLAT_OBJECT = re.compile(r"\{[^{}]*\}")
_BARE_KEY = re.compile(r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:")
_SINGLE_QUOTED = re.compile(r"'([^'\\]*(?:\\.[^'\\]*)*)'")
_LAST_COMMA = re.compile(r",\s*([}\]])")


def _clean(value: object) -> str | None:
    return None if value is None else _HALF.sub("?", " ".join(str(value).split())) or None


def _digits(text: str) -> int | None:
    return int(text) if 0 < len(text) <= 18 else None


def _won(value: object, ranges: bool = False) -> int | None:
    """The first number of a price; none of a price from something on, unless ``ranges``."""
    text = _clean(value)
    if text is None or (not ranges and ("~" in text or "부터" in text)):
        return None
    found = _NUMBER.search(text)
    return _digits(found[0].replace(",", "")) if found else None


def _whole(value: object) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        value = int(value) if value.is_integer() else ""
    return _digits(re.sub(r"[^0-9]", "", value)) if isinstance(value, str) else value if isinstance(value, int) and abs(value) < 10**18 else None


def _decimal(value: object) -> float | None:
    if isinstance(value, bool):
        return None
    try:
        return float(value.strip().replace(",", ".")) if isinstance(value, str) else float(value) if isinstance(value, (int, float)) else None
    except (ValueError, OverflowError):
        return None


def _url(value: object, base: str) -> str | None:
    text = _clean(value)
    if text is None or text.startswith("//"):
        return text and f"https:{text}"
    try:
        return urljoin(base, text)
    except ValueError:  # such as an unclosed bracket in a host
        return None


def _cut(original: int | None, sale: int | None) -> int | None:
    """A sale price that isn't below the original price is none."""
    return sale if sale is not None and (original is None or sale < original) else None


def _id_in(text: str) -> str | None:
    found = re.search(PRODUCT_ID_URL, text) or re.search(PRODUCT_ID_HANDLER, text)
    return found[1] if found else None


def _pick(item: dict, keys: Sequence[str]) -> object:
    return next((item[k] for k in keys if item.get(k) not in ("", None)), None)


def _options_of(value: object) -> list[str] | None:
    if isinstance(value, str):
        return [t] if (t := _clean(value)) else None
    if not isinstance(value, list):
        return None
    named = (_clean(_pick(v, OPTION_KEYS)) if isinstance(v, dict) else _clean(v) if isinstance(v, str) else None for v in value)
    return list(dict.fromkeys(t for t in named if t)) or None


def _sold_out_of(item: dict) -> bool | None:
    gone = _pick(item, KEYS["gone"])
    if isinstance(gone, bool):
        return gone
    word = (_clean(_pick(item, KEYS["stock"])) or "").casefold()
    return True if any(w in word for w in GONE_STOCK) else False if any(w in word for w in IN_STOCK) else None


def record_of(item: dict, base_url: str) -> Record | None:
    """The record of a product object; None if it has no name, brand, image, price and id."""
    get = lambda field: _pick(item, KEYS[field])
    brand, image, offers = get("brand"), get("image"), item.get("offers")
    brand = _pick(brand, BRAND_KEYS) if isinstance(brand, dict) else brand
    image = next((v for v in image if isinstance(v, str)), None) if isinstance(image, list) else image
    offers = offers if isinstance(offers, dict) else {}
    original = _won(get("original"))
    sale = _won(get("sale")) or _won(_pick(offers, ("price", "lowPrice")))
    original = _won(_pick(offers, ("highPrice",))) if original is None else original
    sale = _cut(original, sale)
    price = sale if sale is not None else original
    url = get("url")
    url = _url(url, base_url) if isinstance(url, str) else None
    number = get("id") or _id_in(url or "")
    if not any((get("name"), brand, image, price, number)):
        return None
    number = _clean(number)
    return {
        "source_brand_name": _clean(brand), "product_name_ko": _clean(get("name")), "category": _clean(get("category")), "regular_price": price, "original_price": original, "sale_price": sale,
        "discount_rate": _whole(get("discount")), "rating": _decimal(get("rating")), "review_count": _whole(get("reviews")), "shade": _clean(get("shade")), "description": _clean(get("description")),
        "options": _options_of(get("options")), "sold_out": _sold_out_of(item), "image_url": _url(image, base_url), "source_url": url or (base_url + PRODUCT_PATH + number if number else None),
        "source_product_id": number, "updated_at": _clean(get("updated")),
    }


def _objects(value: object) -> Iterator[dict]:
    """All objects in a JSON value, outer ones first."""
    stack = [value]
    while stack:
        now = stack.pop()
        if isinstance(now, dict):
            yield now
            stack += reversed(now.values())
        elif isinstance(now, list):
            stack += reversed(now)


def _is_product(item: dict) -> bool:
    has = lambda field: any(k in item for k in KEYS[field])
    return has("name") and (has("id") or has("image"))


def _loaded(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _script_object(text: str) -> object:
    """A flat object literal of a script: as JSON, or with its bare keys and single quotes made JSON."""
    found = _loaded(text)
    if found is None:
        text = _SINGLE_QUOTED.sub(lambda m: json.dumps(m[1]), _BARE_KEY.sub(r'\1"\2":', text))
        found = _loaded(_LAST_COMMA.sub(r"\1", text))
    return found


def _scripts(page: Node, linked: Callable[[Node], bool]) -> Iterator[str]:
    for script in page.all("script"):
        if linked(script) and (text := script.text()):
            yield text


def _is_linked(script: Node) -> bool:
    return script.attrs.get("type", "").lower() == "application/ld+json" or script.attrs.get("id") == "__NEXT_DATA__"


def _from_state(page: Node, base_url: str) -> Iterator[Record]:
    """Records of linked data and of page state."""
    for text in _scripts(page, _is_linked):
        for item in _objects(_loaded(text)):
            if _is_product(item) and (r := record_of(item, base_url)):
                yield r


def _from_literals(page: Node, base_url: str) -> Iterator[Record]:
    """Records of object literals in scripts that speak of products."""
    for text in _scripts(page, lambda s: True):
        if not any(m in text for m in LITERAL_MARKS):
            continue
        for found in _FLAT_OBJECT.findall(text):
            if any(n in found for n in LITERAL_NAMES):
                item = _script_object(found)
                if isinstance(item, dict) and (r := record_of(item, base_url)):
                    yield r


def _text_at(node: Node, selectors: Sequence[str], between: str = " ") -> str | None:
    """The clean text of the first selector's first node that has any."""
    for s in selectors:
        if (found := node.first(s)) and (text := _clean(found.text(between))):
            return text
    return None


def _attr_in(node: Node, names: Sequence[str]) -> str | None:
    """The first value of an attribute, of the node itself or of one inside."""
    for n in (node, *(x for x in node.inside() if isinstance(x, Node))):
        for name in names:
            if value := _clean(n.attrs.get(name)):
                return value
    return None


def _image_in(node: Node, base_url: str, names: Sequence[str] = IMAGE_ATTRS) -> str | None:
    for image in node.all("img"):
        if url := _url(next((v for n in names if (v := image.attrs.get(n))), None), base_url):
            return url
    return None


def _prices_in(node: Node) -> tuple[int | None, int | None]:
    def at(selectors: Sequence[str], ranges: bool) -> int | None:
        for s in selectors:
            if (found := node.first(s)) and (price := _won(found.text(), ranges)) is not None:
                return price
        return None

    original = at(LIST_PRICE, False)
    return original, _cut(original, at(PRICE, True))


def _sold_out_in(node: Node) -> bool | None:
    text = node.text()
    return True if any(w in text for w in GONE_WORDS) else None


def _link_in(node: Node, base_url: str) -> str | None:
    for a in node.all("a[href]"):
        href = _clean(a.attrs["href"])
        if href and "getGoodsDetail.do" in href:
            return _url(href, base_url)
        if href and (number := _id_in(href)):
            return base_url + PRODUCT_PATH + number
    number = _id_in(node.raw())
    return base_url + PRODUCT_PATH + number if number else None


def _from_item(node: Node, base_url: str) -> Record | None:
    """The record of a listing's item; None without a name and an id."""
    attr = lambda field: _attr_in(node, ITEM_ATTRS[field])
    original, sale = _prices_in(node)
    original, sale = original or _won(attr("original")), sale or _won(attr("sale"))
    sale = _cut(original, sale)
    name, url = _text_at(node, NAME) or attr("name"), _link_in(node, base_url)
    number = _id_in(url or "") or attr("id") or _id_in(node.raw())
    if not name and not number:
        return None
    return {
        "source_brand_name": _text_at(node, BRAND) or attr("brand"), "product_name_ko": name, "category": attr("category"), "regular_price": sale if sale is not None else original, "original_price": original, "sale_price": sale,
        "sold_out": _sold_out_in(node), "image_url": _image_in(node, base_url) or _url(attr("image"), base_url), "source_url": url or (base_url + PRODUCT_PATH + number if number else None), "source_product_id": number,
    }


def listing_records(html: str | None, base_url: str, limit: int) -> list[Record]:
    """The records of a listing page, of state, then literals, then items; each id once (without one: each brand and name)."""
    page = parsed(html)
    found = [*_from_state(page, base_url), *_from_literals(page, base_url)]
    found += (r for s in ITEMS for node in page.all(s) if (r := _from_item(node, base_url)))
    once: dict[object, Record] = {}
    for r in found:
        once.setdefault(r["source_product_id"] or (r["source_brand_name"], r["product_name_ko"]), r)
    return list(once.values())[:limit]


def _meta(page: Node, name: str) -> str | None:
    found = next((m for m in page.all("meta") if name in (m.attrs.get("property"), m.attrs.get("name"))), None)
    return _clean(found.attrs.get("content")) if found else None


def _option_texts(page: Node) -> Iterator[str]:
    for s in OPTIONS:
        for node in page.all(s):
            text = _clean(node.text())
            if text and not any(w in text for w in OPTION_NOISE):
                yield text


def _folded_once(texts: Iterator[str]) -> list[str]:
    once: dict[str, str] = {}
    for t in texts:
        once.setdefault(t.casefold(), t)
    return list(once.values())


def _rating_in(text: str) -> float | None:
    found = re.search(r"([0-5](?:[.,]\d)?)\s*(?:점|/)", text)
    return _decimal(found[1]) if found else None


def _reviews_in(text: str) -> int | None:
    found = re.search(r"([\d,]+)\s*(?:건|개)?", text) if "리뷰" in text or "review" in text.casefold() else None
    return _whole(found[1]) if found else None


def _number_at(page: Node, selectors: Sequence[str], parse: Callable[[str], object]) -> object:
    return next((v for s in selectors if (n := page.first(s)) and (v := parse(n.text())) is not None), None)


def detail_record(html: str | None, base_url: str, source_url: str | None = None) -> Record:
    """The record of a detail page. What its state says comes first, then its markup, then its meta tags."""
    page = parsed(html)
    base = next(_from_state(page, base_url), {})
    original, sale = _prices_in(page)
    sale = _cut(original, sale or _won(_meta(page, "product:price:amount"), ranges=True))
    original = base.get("original_price") or original or base.get("regular_price")
    sale = _cut(original, base.get("sale_price") or sale)
    texts = list(_option_texts(page))
    shades = (s for t in texts for m in re.findall(SHADE, t) if (s := _clean(m)) and not any(w in s for w in OPTION_NOISE))
    title = _text_at(page, TITLE) or _clean((_meta(page, "og:title") or "").split("|")[0])
    category = next((t for s in CATEGORY if (n := page.first(s)) and (t := _clean(n.text(" > "))) and not any(w in t for w in OPTION_NOISE)), None)
    return {
        "source_brand_name": base.get("source_brand_name") or _text_at(page, BRAND), "product_name_ko": base.get("product_name_ko") or title, "category": base.get("category") or category,
        "regular_price": sale if sale is not None else original, "original_price": original, "sale_price": sale, "discount_rate": base.get("discount_rate"),
        "rating": base.get("rating") or _number_at(page, RATING, _rating_in), "review_count": base.get("review_count") or _number_at(page, REVIEWS, _reviews_in),
        "shade": base.get("shade") or ", ".join(_folded_once(shades)[:MOST_SHADES]) or None, "description": base.get("description") or _meta(page, "og:description"),
        "options": base.get("options") or _folded_once(iter(texts))[:MOST_OPTIONS] or None, "sold_out": base["sold_out"] if base.get("sold_out") is not None else _sold_out_in(page),
        "image_url": base.get("image_url") or _meta(page, "og:image") or _image_in(page, base_url), "source_url": source_url or base.get("source_url"),
        "source_product_id": base.get("source_product_id") or _id_in(source_url or "") or _id_in(page.raw()), "updated_at": base.get("updated_at"),
    }


def _card_noise(text: str) -> bool:
    folded = text.casefold()
    return folded in CARD_NOISE or any(w in folded for w in CARD_NOISE_INSIDE)


def _card_title(text: object) -> str | None:
    return _clean(re.sub(r"^\s*(?:상품명|제품명)\s*[:：]\s*", "", _clean(text) or ""))


def _from_card(node: Node, base_url: str) -> Record | None:
    name = next((t for s in CARD_NAME if (n := node.first(s)) and (t := _card_title(n.attrs.get("title") or n.text())) and not _card_noise(t)), None)
    links = (h for a in node.all("a[href]") if (h := _clean(a.attrs["href"])) and not h.startswith("#") and "javascript:" not in h.casefold())
    url = _url(next((h for h in links if any(w in h.casefold() for w in CARD_LINK)), None), base_url)
    price = next((p for s in CARD_PRICE if (n := node.first(s)) and (p := _won(n.text(), ranges=True)) is not None), None)
    image = _image_in(node, base_url, CARD_IMAGE)
    if not name or not (url or price or image):
        return None
    options = (t for s in CARD_OPTIONS for n in node.all(s) if (t := _clean(n.text())) and not _card_noise(t))
    return {"product_name_ko": name, "regular_price": price, "shade": ", ".join(dict.fromkeys(options)) or None, "image_url": image, "source_url": url, "source_product_id": url}


def card_records(html: str | None, base_url: str, limit: int) -> list[Record]:
    """S12, the cards of a shop's own page, for pages without linked products; each name once, whatever its blanks and signs."""
    page, once = parsed(html), {}
    for r in (r for s in CARDS for node in page.all(s) if (r := _from_card(node, base_url))):
        once.setdefault(re.sub(r"[\s\-_./|+&'():\[\],]+", "", r["product_name_ko"]).casefold() or r["source_url"], r)
    return list(once.values())[:limit]


_TEXT, _NUMBER_TYPE, _WHOLE = pa.string(), pa.float64(), pa.int64()
_TYPES = {n: _TEXT for n in ("source_brand_name", "product_name_ko", "category", "shade", "description", "image_url", "source_url", "source_product_id", "updated_at")}
_TYPES |= {n: _NUMBER_TYPE for n in ("regular_price", "original_price", "sale_price", "rating")}
_TYPES |= {"discount_rate": _WHOLE, "review_count": _WHOLE, "options": pa.list_(_TEXT), "sold_out": pa.bool_()}
_NAMES = {_TEXT: "string", _NUMBER_TYPE: "double", _WHOLE: "long", pa.list_(_TEXT): "array<string>", pa.bool_(): "boolean"}


def _parsed_pages(pages: DataFrame, parse: Callable[[str | None, str | None], list[Record]], source: str, id_col: str, html_col: str, url_col: str | None) -> DataFrame:
    """``id``, ``place`` (from 0) and the fields of each record of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(2).to_pylist()
            found = [(i, place, r) for i, html in enumerate(b.column(1).to_pylist()) for place, r in enumerate(parse(html, urls[i]))]
            ids = b.column(0).take(pa.array([i for i, _, _ in found], pa.int64()))
            fields = (pa.array([None if (v := r.get(n)) is None else float(v) if t == _NUMBER_TYPE else v for _, _, r in found], t) for n, t in _TYPES.items())
            yield pa.RecordBatch.from_arrays([ids, pa.array([p for _, p, _ in found], pa.int32()), *fields], ["id", "place", *_TYPES])

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, place int, " + ", ".join(f"{n} {_NAMES[t]}" for n, t in _TYPES.items())
    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"))
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumn("source", F.lit(source))


def parse_listing_pages(pages: DataFrame, base_url: str, source: str = "oliveyoung", limit: int = 1000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each record of a listing page, in the page's order: ``id, place`` and fields of a source record.

    ``limit`` is the most records of a page. Null, empty and broken pages give what can be read in them; repeated pages
    and null ids stay. Numbers of more than 18 digits are null.
    """
    return _parsed_pages(pages, lambda html, _: listing_records(html, base_url, limit), source, id_col, html_col, None)


def parse_detail_pages(pages: DataFrame, base_url: str, source: str = "oliveyoung", id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """A row for each page; a page that says nothing has the id of its URL, if that has one, and nulls."""
    return _parsed_pages(pages, lambda html, url: [detail_record(html, base_url, url)], source, id_col, html_col, url_col)


def parse_card_pages(pages: DataFrame, base_url: str, brand: str | None = None, source: str = "official", limit: int = 1000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Records of the cards of shops' own pages, all of ``brand``."""
    rows = _parsed_pages(pages, lambda html, _: card_records(html, base_url, limit), source, id_col, html_col, None)
    return rows.withColumn("source_brand_name", F.lit(brand).cast("string"))
