"""Files and payloads round trip; pages give their evidence; pasted lines parse and resolve."""

import json

from pyspark.sql import functions as F

from quillmart.operators import editor, normalize
from quillmart.sources import pages, payloads, tables


def test_generic_payload(spark):
    item = {"brandName": "클리오", "productName": " 립  틴트 ", "categories": ["메이크업", "", "립"], "price": "12,000원", "salePrice": 9000, "rating": "4,5", "reviewCount": "1,203", "options": [{"name": "A"}, "B", "B"], "available": True, "url": "http://x/1", "id": 7}
    docs = [{"data": {"items": [item, "text", {"desc": "nothing"}]}}, [item], {"results": [], "other": 1}, {"products": {"results": [item]}}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")
    rows = payloads.map_json_payload(df, "external").collect()
    assert len(rows) == 3
    r = rows[0]
    assert (r["source_brand_name"], r["product_name_ko"], r["category"], r["regular_price"], r["sale_price"]) == ("클리오", "립 틴트", "메이크업 > 립", 12000.0, 9000.0)
    assert (r["rating"], r["review_count"], r["options"], r["sold_out"], r["source_product_id"], r["currency"]) == (4.5, 1203, ["A", "B"], False, "7", "KRW")


def test_retailer_payloads(spark):
    a = [{"goodsNo": "A1", "goodsName": "[특가] 페리페라 브로우", "originalPrice": 10000, "priceToPay": 8000, "discountRate": 20}, {"goodsNo": "A2", "goodsName": "x", "originalPrice": 10000, "priceToPay": 10000, "discountRate": 0}]
    rows = payloads.map_retailer_a_payload(spark.createDataFrame([(json.dumps({"data": {"goodsList": a}}),)], "payload string"), "https://shop.example/").collect()
    assert [(r["source_brand_name"], r["sale_price"], r["regular_price"], r["discount_rate"]) for r in rows] == [("페리페라", 8000.0, 8000.0, 20), ("x", None, 10000.0, None)]
    assert rows[0]["source_url"] == "https://shop.example/store/goods/getGoodsDetail.do?goodsNo=A1"
    b = [{"goodsNo": 5, "goodsName": "n", "brand": {"brandName": "B"}, "normalPrice": 100, "salePrice": 100, "isSoldOut": True}, {"goodsName": "m", "salePrice": 50, "category": {"categoryName": "c"}, "link": "u"}]
    rows = payloads.map_retailer_b_payload(spark.createDataFrame([(json.dumps({"data": {"list": b}}),)], "payload string"), "https://b/").collect()
    assert [(r["source_brand_name"], r["sale_price"], r["regular_price"], r["source_url"], r["category"], r["sold_out"]) for r in rows] == [("B", None, 100.0, "https://b/5", None, True), (None, 50.0, 50.0, "u", "c", None)]


def test_storefront_payload(spark):
    items = [
        {"id": 1, "title": "Lip Rouge", "handle": "lip", "vendor": "V", "images": [{"src": "i.jpg"}], "variants": [{"price": "10.5", "title": "Default Title"}, {"price": "8", "compare_at_price": "12", "title": "Red"}, {"price": "7", "compare_at_price": "20", "title": "Blue"}]},
        {"id": 2, "title": "립밤", "variants": []},
    ]
    df = spark.createDataFrame([(json.dumps({"products": items}),)], "payload string")
    rows = {r["source_product_id"]: r for r in payloads.map_storefront_payload(df, "d.example", "Brand").collect()}
    r = rows["1"]
    assert (r["regular_price"], r["sale_price"], r["options"], r["product_name_en"], r["product_name_ko"], r["source_url"]) == (12.0, 8.0, ["Red", "Blue"], "Lip Rouge", None, "https://d.example/products/lip")
    assert rows["2"]["product_name_ko"] == "립밤" and rows["2"]["regular_price"] is None
    assert payloads.map_storefront_payload(df, "d.example", "Brand", "v").count() == 1


def test_catalog_registry_and_expansions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"products": [{"goods_no": "1", "brand_ko": "클리오", "product_name_ko": "립", "keywords": ["k"], "price": 5}, {"source": "x", "source_product_id": "2"}]}))
    rows = {r["source_product_id"]: r for r in tables.read_catalog(spark, f"{tmp_path}/c.json").collect()}
    assert (rows["1"]["search_keywords"], rows["1"]["source"], rows["1"]["currency"], rows["1"]["regular_price"], rows["2"]["source"]) == (["k"], "verified", "KRW", 5.0, "x")
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"official_en": "AND", "aliases": ["Aand", "앤드"], "sources": []}, {"official_en": "Other", "aliases": ["a-and", " "], "sources": []}]}))
    got = {r["alias_key"]: (r["alias"], r["official_en"]) for r in normalize.alias_table(tables.read_brand_registry(spark, f"{tmp_path}/r.json")).collect()}
    assert got == {"aand": ("Aand", "AND"), "앤드": ("앤드", "AND"), "엔드": ("엔드", "AND"), "and": ("AND", "AND"), "other": ("Other", "Other")}
    (tmp_path / "s.json").write_text(json.dumps({"립": ["틴트", "밤"]}))
    (tmp_path / "i.json").write_text(json.dumps({"dry": {"labels": ["건조"], "terms": ["수분"]}}))
    got = sorted((r["kind"], r["entry"], r["terms"]) for r in tables.read_expansions(spark, f"{tmp_path}/s.json", f"{tmp_path}/i.json").collect())
    assert got == [("intent", "건조", ["수분"]), ("synonym", "립", ["틴트", "밤"])]


def test_brand_mentions_by_either_way(spark, monkeypatch):
    aliases = spark.createDataFrame([("clio", "Clio", "CLIO", 0), ("클리오", "클리오", "CLIO", 1), ("클리오프로", "클리오프로", "PRO", 2)], "alias_key string, alias string, official_en string, position int")
    rows = spark.createDataFrame([("클 리오", "x"), (None, "새 클리오 프로 립"), ("Latin", "none"), ("한글", None), (None, None)], "brand string, name string")
    want = [("CLIO"), ("PRO"), ("Latin"), None, None]
    for limit in (1000, 1):
        monkeypatch.setattr(normalize, "ALIAS_LITERALS", limit)
        got = {(r["brand"], r["name"]): r["brand_en"] for r in normalize.resolve_brand(rows, aliases, "brand", ["name"]).collect()}
        assert [got[(r["brand"], r["name"])] for r in rows.collect()] == want


def test_exports_round_trip(spark, tmp_path):
    rows = [("p1", 'A "quoted", name', "B", 1000.0, 900.0, ["x", "y|z"], True, "s"), ("p2", "n\nm", None, 1000.0, 1000.0, None, None, "s")]
    df = tables.assert_record_schema(spark.createDataFrame(rows, "source_product_id string, product_name_ko string, source_brand_name string, regular_price double, sale_price double, options array<string>, sold_out boolean, source string"))
    assert tables.write_products_csv(df, f"{tmp_path}/out") == 2
    back = {r["source_product_id"]: r for r in tables.read_products_csv(spark, f"{tmp_path}/out").collect()}
    assert (back["p1"]["product_name_ko"], back["p1"]["sale_price"], back["p1"]["options"], back["p1"]["sold_out"]) == ('A "quoted", name', 900.0, ["x", "y|z"], True)
    assert (back["p2"]["product_name_ko"], back["p2"]["sale_price"], back["p2"]["options"]) == ("n m", None, None)
    for fmt in ("csv", "json", "parquet"):
        tables.write_targets(df.select("source_product_id"), f"{tmp_path}/t-{fmt}", fmt)
        assert spark.read.format(fmt).option("header", "true").load(f"{tmp_path}/t-{fmt}").count() == 2


def test_match_candidate_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"canonical_product_id":"c","source":"s","source_product_id":"1","confidence":0.8}\n')
    (tmp_path / "m.csv").write_text("canonical_product_id,source,source_product_id,source_url,match_method,confidence,original_price,sale_price,currency,image_url,sold_out,evidence_note\nc,s,1,u,title,0.8,,,,,,\n")
    for name in ("m.jsonl", "m.csv"):
        (r,) = tables.read_match_candidates(spark, f"{tmp_path}/{name}").collect()
        assert (r["canonical_product_id"], r["source_product_id"], r["confidence"]) == ("c", "1", "0.8")


def test_blocked_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, 200, "ok", None), (2, 403, "ok", None), (3, 200, "Please solve the CAPTCHA", None), (4, None, None, None), (5, 200, "ok", "Challenge")], "id int, status int, body string, header string")
    assert sorted(r["id"] for r in tables.drop_blocked_pages(df, "status", "body", ["header"]).collect()) == [1, 4]
    tables.snapshot(df, f"{tmp_path}/snap")
    assert tables.restore_products(spark, f"{tmp_path}/snap", df, lambda rows: rows.groupBy("id").count()).where("count = 2").count() == 5


PAGE = """<html><head><title> Lip &amp; Co </title><meta property="og:title" content="Lip  Rouge"><meta itemprop="price" content="12.5"><meta name="og:price:currency" content="KRW">
<meta property="og:image" content="i.jpg"><script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"Lip Rouge","image":["i.jpg",{"url":"j.jpg"}],"offers":{"price":9,"priceCurrency":"USD"}}]}</script>
<script type="application/ld+json">{broken</script></head></html>"""


def test_page_evidence(spark):
    got = {r["page_id"]: r for r in pages.page_evidence(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).collect()}
    r = got[1]
    assert [(e["source"], e["name"]) for e in r["names"]] == [("json_ld", "Lip Rouge"), ("title", "Lip & Co")]
    assert [e["url"] for e in r["images"]] == ["i.jpg", "j.jpg"]
    assert [(e["price"], e["currency"]) for e in r["prices"]] == [("9", "USD"), ("12.5", "KRW")]
    assert got[2]["names"] == [] and got[3]["prices"] == []
    assert pages.titles(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).first()["title"] == "Lip &amp; Co"


def test_editor_lines(spark):
    lines = ["헤라 파우더 #13N1", "캔메이크 아라 카푸치노", "클리오 쿠션 21호 본품", "clio tint #Red #02", "브랜드", "a b 파우더", "", None]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", editor.parse_line(F.col("line")).alias("p")).select("i", "p.*")
    got = {r["i"]: (r["brand_query"], r["product_query"], r["shade_code"], r["shade_name"], r["normalized_query"]) for r in df.collect()}
    assert got[0] == ("헤라", "파우더", "13N1", None, "헤라 파우더")
    assert got[1] == ("캔메이크", "아라", None, "카푸치노", "캔메이크 아라")
    assert got[2] == ("클리오", "쿠션", "21호", "본품", "클리오 쿠션")
    assert got[3] == ("clio", "tint", "02", "Red", "clio tint")
    assert got[4] == ("브랜드", None, None, None, "브랜드")
    assert got[5] == ("a", "b 파우더", None, None, "a b 파우더")
    assert got[6][0] is None and got[7][4] == ""


def test_editor_resolution(spark):
    lines = spark.createDataFrame([(1, "Clio cushion #02"), (2, "Hera lip"), (3, "Nobody thing")], "line_id int, line string").select("line_id", editor.parse_line(F.col("line")).alias("p")).select("line_id", "p.*")
    steps = editor.ladder(lines)
    assert {(r["line_id"], r["step"], r["query"]) for r in steps.collect()} >= {(1, 0, "Clio cushion 02"), (1, 1, "Clio cushion"), (1, 2, "cushion"), (2, 0, "Hera lip")}
    products = spark.createDataFrame(
        [("a", None, "Clio", None, "Kill cushion 02", None, None, "u", "i", 50, 10), ("b", None, "Clio", None, "Kill cushion 03", None, None, "u", None, 50, 10), ("c", None, "Hera", None, "Lip one", None, None, "u", None, 40, 10), ("d", None, "Hera", None, "Lip two", None, None, "u", None, 60, 10), ("e", None, "X", None, "cushion", None, None, None, None, 9, 1)],
        "product_id string, brand_ko string, brand_en string, name_ko string, name_en string, shade string, category string, source_url string, image_url string, quality_score int, source_priority int",
    )
    pairs = lines.join(steps.drop("query"), "line_id").join(products, F.contains(F.lower("normalized_query"), F.lower("brand_en")))
    done = editor.resolve_lines(lines, editor.judge_candidates(pairs), 1)
    assert {r["line_id"]: (r["status"], r["n_candidates"], r["best"]) for r in done.collect()} == {1: (editor.CONFIRMED, 1, "a"), 2: (editor.CONFIRMED, 1, "d"), 3: (editor.MANUAL, 0, None)}
    both = editor.resolve_lines(lines, editor.judge_candidates(pairs), 5)
    assert {r["line_id"]: r["status"] for r in both.collect()} == {1: editor.CANDIDATES, 2: editor.CANDIDATES, 3: editor.MANUAL}
    assert {r["status"]: r["lines"] for r in editor.batch_summary(both).collect()} == {editor.CANDIDATES: 2, editor.MANUAL: 1}
    boxes = spark.createDataFrame([(1, 2, "B", " ", "x", "l"), (1, 1, "A", "n", None, "k")], "box_id int, position int, brand string, name string, shade string, link string")
    assert editor.description_text(boxes).first()["text"] == "A n\nB x"
    assert editor.description_text(boxes, links=True).first()["text"] == "A n k\nB x l"


def test_initials_and_korean_brands(spark):
    aliases = spark.createDataFrame([("클리오", "클리오", "CLIO", 0), ("헤라", "헤라", "HERA", 1), ("clio", "Clio", "CLIO", 2)], "alias_key string, alias string, official_en string, position int")
    texts = spark.createDataFrame([(1, "새 ㅋ리ㅇ 쿠션"), (2, "ㅎㄹ"), (3, "클리오"), (4, "ㅎㄴ"), (5, None)], "id int, text string")
    got = {r["key"]: r["official_en"] for r in normalize.initials_match(texts, aliases, "id", "text").collect()}
    assert got == {1: "CLIO", 2: "HERA"}
    assert spark.range(1).select(normalize.hangul_initials(F.lit("까힣a"))).first()[0] == "ㄲㅎa"
    rows = spark.createDataFrame([("클 리오", "클리오"), ("헤라", "클리오"), ("[특가]", "클리오"), ("Latin", "클리오"), ("Latin", "Clio"), ("헤", "헤라"), ("단독", "헤라")], "b string, a string")
    assert [r[0] for r in rows.select(normalize.brand_ko(F.col("b"), F.col("a"), ["단독"])).collect()] == ["클리오", "헤라", "클리오", "클리오", None, "헤라", "헤라"]


def test_export_report_and_exact_expansions(spark):
    from quillmart.operators import quality, results

    schema = "source string, source_brand_name string, brand_ko string, brand_en string, product_name_ko string, product_name_en string, product_name_display_ko string, rating double, review_count int, options array<string>, sold_out boolean, quality_score int"
    rows = [("a:x", "B", "비", None, "n", "N", "n", 4.0, None, ["o"], True, 80), ("a", None, None, "C", "[x] m", None, "m", None, 2, None, None, 61)]
    got = {(r["measure"], r["name"]): r["value"] for r in quality.export_report(spark.createDataFrame(rows, schema)).collect()}
    assert (got["total", "total"], got["total", "mean_quality"], got["source", "a"], got["brand", "B"], got["total", "brand_corrected"], got["total", "display_cleaned"], got["total", "options"]) == (2, 70.5, 2, 1, 1, 1, 1)
    asked = spark.createDataFrame([(1, "Lip Tint"), (2, "other")], "query_id int, query string")
    table = spark.createDataFrame([("립틴트", ["a", "b", "c"])], "entry string, terms array<string>")
    assert sorted(map(tuple, results.exact_expansions(asked, table, 2).collect())) == [(1, 1, "a"), (1, 2, "b")]


def test_products_of_pages(spark):
    linked = {"@graph": [{"@type": "Product", "name": "Lip", "brand": {"name": "B"}, "image": "../i.jpg", "url": "/p/1", "sku": 7, "offers": [{"price": "1,200", "priceCurrency": "KRW", "availability": "http://schema.org/OutOfStock"}], "aggregateRating": {"ratingValue": "4.5", "reviewCount": 3}}, {"@type": "Product", "name": "Lip", "brand": "B"}, {"@type": "Product"}]}
    html = f'<script type="application/ld+json">{json.dumps(linked)}</script>'
    (r,) = pages.parse_product_pages(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string"), "https://shop.example/a/b", "external").collect()
    assert (r["page_id"], r["source_brand_name"], r["product_name_ko"], r["regular_price"], r["image_url"], r["source_url"], r["source_product_id"]) == (1, "B", "Lip", 1200.0, "https://shop.example/i.jpg", "https://shop.example/p/1", "7")
    assert (r["rating"], r["review_count"], r["sold_out"], r["source"]) == (4.5, 3, True, "external")
