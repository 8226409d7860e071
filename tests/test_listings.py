"""Listing, detail and card pages: markup of shops, what is broken, and what is missing."""

import json

import pytest

from quillmart.sources import listings, markup, pages

BASE = "https://www.oliveyoung.co.kr"
DETAIL = BASE + "/store/goods/getGoodsDetail.do?goodsNo="

#: Listing markup, and fields of the first record it has to give.
LISTINGS = [
    (
        """<ul class="cate_prd_list"><li><div class="prd_info"><a href="javascript:common.link.moveGoodsDetail('A000000113988');"><img src="//image.oliveyoung.co.kr/item.jpg" alt="상품명 이미지" /></a>
        <div class="prd_name"><a><span class="tx_brand">BRTC</span><p class="tx_name">BRTC V10 비타민 화이트닝 슬리핑팩 100ml</p></a></div>
        <p class="prd_price"><span class="tx_org"><span class="tx_num">24,000</span>원</span></p></div></li></ul>""",
        {"source_brand_name": "BRTC", "product_name_ko": "BRTC V10 비타민 화이트닝 슬리핑팩 100ml", "regular_price": 24000, "image_url": "https://image.oliveyoung.co.kr/item.jpg", "source_product_id": "A000000113988", "source_url": DETAIL + "A000000113988"},
    ),
    ('<ul class="cate_prd_list"><li><span class="tx_brand">브랜드</span><p class="tx_name">옵션 가격 상품</p><p class="prd_price"><span class="tx_cur">19,900 원 ~</span></p></li></ul>', {"regular_price": 19900}),
    (
        '<ul class="cate_prd_list"><li><p class="tx_name">선크림</p><p class="prd_price"><span class="tx_org"><span class="tx_num">25,000</span>원</span><span class="tx_cur"><span class="tx_num">23,900</span>원</span></p></li></ul>',
        {"regular_price": 23900, "original_price": 25000, "sale_price": 23900},
    ),
    (
        '<ul class="cate_prd_list"><li><p class="tx_name">무할인</p><p class="prd_price"><span class="tx_org"><span class="tx_num">17,000</span>원</span><span class="tx_cur"><span class="tx_num">17,000</span>원</span></p></li></ul>',
        {"regular_price": 17000, "original_price": 17000, "sale_price": None},
    ),
    (
        """<ul><li data-ref-goodsno="A000000111111"><a href="/store/goods/getGoodsDetail.do?goodsNo=A000000111111"><img src="https://image.oliveyoung.co.kr/item.jpg" /></a><p class="ProductCard_brand__abc">식물나라</p>
        <h3 data-qa-name="text-product-title">식물나라 가벼운 수분 선 젤 60ml 단품/2입 기획</h3><span data-qa-name="text-product-original-price">25,800원</span></li></ul>""",
        {"source_brand_name": "식물나라", "product_name_ko": "식물나라 가벼운 수분 선 젤 60ml 단품/2입 기획", "regular_price": 25800},
    ),
    (
        """<ul><li data-goods-no="A000000238408" data-brand-nm="믹순" data-goods-nm="믹순 히알레배 포어 블러링 크림 50ml" data-normal-price="14,900" data-img-url="//image.oliveyoung.co.kr/item.jpg"></li></ul>""",
        {"source_brand_name": "믹순", "product_name_ko": "믹순 히알레배 포어 블러링 크림 50ml", "regular_price": 14900, "image_url": "https://image.oliveyoung.co.kr/item.jpg", "source_url": DETAIL + "A000000238408"},
    ),
    (
        """<script>window.searchGoods = [{ goodsNo: 'A000000238408', onlBrndNm: '믹순', goodsNm: '믹순 히알레배 포어 블러링 크림 50ml', nrmlAmt: '14900', mainImgUrl: '//image.oliveyoung.co.kr/item.jpg' }];</script>""",
        {"source_brand_name": "믹순", "product_name_ko": "믹순 히알레배 포어 블러링 크림 50ml", "regular_price": 14900, "source_product_id": "A000000238408"},
    ),
    (
        """<script type="application/ld+json">{"@type": "Product", "goodsNo": "A000000238409", "brandName": "롬앤", "goodsName": "롬앤 글래스팅 컬러 글로스", "categoryName": "메이크업 > 립", "originalPrice": "13000", "priceToPay": "9900",
        "discountRate": "23", "ratingValue": "4.7", "reviewCount": "321", "description": "원본 설명", "options": ["01 피오니 발레"], "stockStatus": "in_stock", "imageUrl": "//image.oliveyoung.co.kr/item.jpg"}</script>""",
        {"category": "메이크업 > 립", "sale_price": 9900, "discount_rate": 23, "rating": 4.7, "review_count": 321, "description": "원본 설명", "options": ["01 피오니 발레"], "sold_out": False},
    ),
]


@pytest.mark.parametrize("html, want", LISTINGS)
def test_listing_markup(html, want):
    (record,) = listings.listing_records(html, BASE, 10)
    assert {k: record.get(k) for k in want} == want


def test_detail_markup():
    html = """<div class="GoodsDetailInfo_title-area__unu7g" data-qa-name="text-product-title"><h3 class="GoodsDetailInfo_title__Vl_IP">[NEW] 공식 제품명</h3></div>
    <span class="GoodsDetailInfo_price__AoTh8" data-qa-name="text-product-discount-price"><span>13,000</span><span>원 ~</span></span>"""
    record = listings.detail_record(html, BASE)
    assert (record["product_name_ko"], record["regular_price"], record["sale_price"]) == ("[NEW] 공식 제품명", 13000, 13000)
    html = """<html><head><meta property="og:title" content="컬러 립 틴트 | 올리브영" /></head><body><button class="prd_brand">fwee</button>
    <ul class="prd_option_box"><li>01. 베이비 핑크</li><li>02. 로지 코랄</li></ul></body></html>"""
    record = listings.detail_record(html, BASE)
    assert (record["product_name_ko"], record["source_brand_name"], record["shade"]) == ("컬러 립 틴트", "fwee", "01. 베이비 핑크, 02. 로지 코랄")
    assert record["options"] == ["01. 베이비 핑크", "02. 로지 코랄"]


def test_records_are_given_once_in_order():
    state = json.dumps({"list": [{"id": 7, "name": "a", "price": "1,000원", "brand": {"brandNm": "B"}}, {"deep": [{"goodsNo": "X8", "name": "b", "offers": {"lowPrice": 900, "highPrice": 1200}, "options": ["o", {"title": "p"}, "o", 3]}]}]})
    html = f"""<script id="__NEXT_DATA__">{state}</script><script>var x = [{{"goodsNo":"X8","goodsNm":"again"}}, {{goodsNo: 'X9', goodsNm: 'c', soldOut: true,}}, {{goodsNo: broken}}]</script>
    <ul class="prd_list"><li data-goods-no="X9"></li><li data-goods-no="X10" title="d"> 품절 </li><li>nothing</li><li><p class="tx_name">e</p></li><li><p class="tx_name">e</p></li></ul>"""
    got = listings.listing_records(html, BASE, 10)
    assert [(r["source_product_id"], r["product_name_ko"], r["regular_price"], r["sale_price"], r["sold_out"]) for r in got] == [
        ("7", "a", 1000, 1000, None), ("X8", "b", 900, 900, None), ("X9", "c", None, None, True), ("X10", "d", None, None, True), (None, "e", None, None, None),
    ]
    assert got[1]["options"] == ["o", "p"] and got[1]["original_price"] == 1200
    assert len(listings.listing_records(html, BASE, 2)) == 2


BROKEN = ["", "<", "</", "<p", "<![foo[ x ]]><p class=tx_name>a", "<script>var x = {goodsNo: '", '<script type="application/ld+json">{"name": "\\ud800", "id": 1}</script>', "<li data-goods-no>" * 3000 + "품절", "<script>" + "{goodsNo" * 5000, '<script id="__NEXT_DATA__">' + "[" * 20_000 + "</script>",
          '<script type="application/ld+json">{"name": ["x"], "id": {"a": 1}, "price": 1e999, "reviewCount": 99999999999999999999999, "url": "http://[x", "image": [1]}</script>', "<meta property='og:title' content>", "<select><option>" * 2000]


def test_broken_pages_give_what_is_in_them(spark):
    rows = [(i, h, None) for i, h in enumerate(BROKEN)] + [(100, None, "https://x/?goodsNo=U1"), (None, LISTINGS[0][0], None), (None, LISTINGS[0][0], None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, html string, url string, place string").repartition(3)
    found = listings.parse_listing_pages(df, BASE).collect()
    assert sorted(r["page_id"] for r in found if r["page_id"] is not None) == [6, 10] and sum(r["page_id"] is None for r in found) == 2
    by_page = {r["page_id"]: r for r in found}
    assert by_page[6]["product_name_ko"] == "?" and (by_page[10]["source_url"], by_page[10]["review_count"]) == (DETAIL + "{'a': 1}", None)
    details = listings.parse_detail_pages(df, BASE).collect()
    assert len(details) == len(rows)
    (empty,) = [r for r in details if r["page_id"] == 100]
    assert empty["source_product_id"] == "U1" and empty["product_name_ko"] is None and empty["options"] is None
    for f in (listings.parse_listing_pages, listings.parse_detail_pages, listings.parse_card_pages):
        assert f(df.limit(0), BASE).collect() == []
    assert len(pages.page_evidence(df.select("page_id", "html")).collect()) == len(rows)


def test_cards_of_a_shop(spark):
    html = """<ul><li class="item xans-record-"><a href="#x"></a><a href="/product/1"><img ec-data-src="a.jpg"></a><strong class="prd-name">상품명 : Lip  Tint</strong><span class="price">12,000원 ~</span>
    <ul class="color-list"><li>Red</li><li>Red</li><li>옵션</li></ul></li><li class="product">no name</li><li class="product-2"><p class="title">LIP-TINT</p><p class=sale>9</p></li><li class="item"><b class="name">More</b></li></ul>"""
    (r,) = listings.parse_card_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://shop.example/a/", "B").collect()
    assert (r["product_name_ko"], r["regular_price"], r["source_url"], r["image_url"], r["shade"], r["source_brand_name"], r["source"]) == ("Lip Tint", 12000.0, "https://shop.example/product/1", "https://shop.example/a/a.jpg", "Red", "B", "official")


def test_selectors_and_texts():
    page = markup.parsed("<div class='a b'><p id=1>x<br>y<script>z</script><p id=2 data-n='q r'>w</div></b><div><p id=3><style>s</style> v </p></div>")
    ids = lambda s: [n.attrs["id"] for n in page.all(s)]
    assert ids("p") == ["1", "2", "3"] and ids("div.a > p") == ["1"] and ids(".b p") == ["1", "2"] and ids("[data-n*='q']") == ["2"] and ids("[data-n='q']") == []
    assert page.text() == "x y w v" and page.first("script").text() == "z" and page.first("style").text() == "s"
    with pytest.raises(ValueError):
        list(page.all("p:first"))
    deep = markup.parsed("<i>" * 2000 + "x")
    assert deep.text() == "x" and sum(1 for n in deep.all("i")) == 2000
