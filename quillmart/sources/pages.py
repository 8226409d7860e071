"""Evidence from product pages: names, images and prices of JSON-LD, meta tags and titles."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.text import clean_text
from quillmart.sources.markup import Tolerant

#: Keys of meta tags that tell a name, an image, a price, a currency.
NAME_KEYS = {"og:title", "twitter:title", "title", "product:name", "name"}
IMAGE_KEYS = {"og:image", "twitter:image", "image", "product:image"}
PRICE_KEYS = {"product:price:amount", "og:price:amount", "price", "product:price"}
CURRENCY_KEYS = {"product:price:currency", "og:price:currency", "pricecurrency"}


def titles(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(page_id, title)``: the text of the first title element, cleaned; entities stay as they are."""
    return pages.select("page_id", clean_text(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


class _Page(Tolerant):
    """One pass over a page; what it says of a product, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.linked: list[str] = []
        self.metas: list[tuple[str, str]] = []
        self.title = ""
        self.within = ""

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "script" and given.get("type", "").lower() == "application/ld+json":
            self.within = "ld"
            self.linked.append("")
        elif tag == "title" and not self.title:
            self.within = "title"
        elif tag == "meta":
            key, content = given.get("property") or given.get("name") or given.get("itemprop") or "", " ".join(given.get("content", "").split())
            if content:
                self.metas.append((key.casefold(), content))

    def handle_endtag(self, tag):
        if tag in ("script", "title"):
            self.within = ""

    def handle_data(self, data):
        if self.within == "ld":
            self.linked[-1] += data
        elif self.within == "title":
            self.title += data


def _products(node) -> Iterator[dict]:
    """The Product objects of a JSON-LD value, in lists and graphs too."""
    if isinstance(node, list):
        for x in node:
            yield from _products(x)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if "Product" in (kind if isinstance(kind, list) else [kind]):
            yield node
        yield from _products(node.get("@graph"))


def _texts(value) -> Iterator[str]:
    for x in value if isinstance(value, list) else [value]:
        text = x.get("url") if isinstance(x, dict) else x
        if isinstance(text, (str, int, float)) and not isinstance(text, bool) and (clean := " ".join(str(text).split())):
            yield clean


def evidence_of(html: str | None) -> dict[str, list[dict[str, str | None]]]:
    """Names, images and prices that a page gives, each value once, where it is found first. A page that can't be parsed gives none."""
    page = _Page()
    page.feed(html or "")
    names, images, prices = [], [], []
    for payload in page.linked:
        try:
            found = list(_products(json.loads(payload)))
        except ValueError:
            continue
        for product in found:
            names += [("json_ld", t) for t in _texts(product.get("name"))]
            images += [("json_ld", t) for t in _texts(product.get("image"))]
            offers = product.get("offers")
            for offer in offers if isinstance(offers, list) else [offers]:
                if isinstance(offer, dict):
                    price = next(_texts(offer.get("price", offer.get("lowPrice"))), None)
                    if price:
                        prices.append(("json_ld", price, offer.get("priceCurrency") if isinstance(offer.get("priceCurrency"), str) else None))
    names += [(k, v) for k, v in page.metas if k in NAME_KEYS]
    images += [(k, v) for k, v in page.metas if k in IMAGE_KEYS]
    currency = next((v for k, v in page.metas if k in CURRENCY_KEYS), None)
    prices += [(k, v, currency) for k, v in page.metas if k in PRICE_KEYS]
    if title := " ".join(page.title.split()):
        names.append(("title", title))
    return {
        "names": [{"source": s, "name": v} for v, s in _first((v, s) for s, v in names)],
        "images": [{"source": s, "url": v} for v, s in _first((v, s) for s, v in images)],
        "prices": [{"source": s, "price": v, "currency": c} for (v, c), s in _first(((v, c), s) for s, v, c in prices)],
    }


def _first(pairs):
    out = {}
    for key, value in pairs:
        out.setdefault(key, value)
    return out.items()


def page_evidence(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, names, images, prices)`` of every page, by one parse each; a null page gives empty arrays."""
    text = pa.string()
    kinds = {
        "names": pa.list_(pa.struct([("source", text), ("name", text)])),
        "images": pa.list_(pa.struct([("source", text), ("url", text)])),
        "prices": pa.list_(pa.struct([("source", text), ("price", text), ("currency", text)])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [evidence_of(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], t) for k, t in kinds.items())], ["id", *kinds])

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, names array<struct<source:string,name:string>>, images array<struct<source:string,url:string>>, prices array<struct<source:string,price:string,currency:string>>"
    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _number(value) -> float | None:
    try:
        return float(str(value).replace(",", ""))
    except ValueError:
        return None


def products_of(html: str | None, base_url: str) -> list[dict]:
    """The products that a page's JSON-LD lists, each brand and name once; pages without any give none."""
    page = _Page()
    page.feed(html or "")
    out: dict[tuple[str | None, str], dict] = {}
    for payload in page.linked:
        try:
            found = list(_products(json.loads(payload)))
        except ValueError:
            continue
        for product in found:
            name = next(_texts(product.get("name")), None)
            if not name:
                continue
            brand = product.get("brand")
            brand = next(_texts(brand.get("name") if isinstance(brand, dict) else brand), None)
            offers = product.get("offers")
            offer = next((o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)), {})
            rating = product.get("aggregateRating") if isinstance(product.get("aggregateRating"), dict) else {}
            stock = str(offer.get("availability", "")).casefold()
            url, image = next(_texts(product.get("url") or offer.get("url")), None), next(_texts(product.get("image")), None)
            reviews = _number(rating.get("reviewCount", rating.get("ratingCount", "")))
            out.setdefault((brand, name), {
                "source_brand_name": brand,
                "product_name_ko": name,
                "regular_price": _number(offer.get("price", offer.get("lowPrice", ""))),
                "currency": next(_texts(offer.get("priceCurrency")), None),
                "rating": _number(rating.get("ratingValue", "")),
                "review_count": None if reviews is None else int(reviews),
                "image_url": image and urljoin(base_url, image),
                "source_url": url and urljoin(base_url, url),
                "source_product_id": next(_texts(product.get("sku") or product.get("productID")), None),
                "category": next(_texts(product.get("category")), None),
                "sold_out": True if "outofstock" in stock or "soldout" in stock else False if "instock" in stock else None,
            })
    return list(out.values())


def parse_product_pages(pages: DataFrame, base_url: str, source: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S12, the JSON-LD path: ``id`` and a record for each product that a page lists, in its order. ``../`` URLs are resolved."""
    text, number = pa.string(), pa.float64()
    kinds = {n: text for n in ("source_brand_name", "product_name_ko", "currency", "image_url", "source_url", "source_product_id", "category")}
    kinds |= {"regular_price": number, "rating": number, "review_count": pa.int32(), "sold_out": pa.bool_()}
    names = {text: "string", number: "double", pa.int32(): "int", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, p) for i, h in enumerate(b.column(1).to_pylist()) for p in products_of(h, base_url)]
            ids = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([p[n] for _, p in found], t) for n, t in kinds.items())], ["id", *kinds])

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in kinds.items())
    rows = pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_col).withColumn("source", F.lit(source))
