"""Display names against golden names, and translated types against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quillmart.functions import names
from quillmart.operators import normalize

#: Names of retail listings, a brand's names, and the display names they have to give.
GOLDEN = [
    (["페리페라", "peripera"], "[6월 올영픽] 페리페라 스피디 스키니 브로우 8 Colors (단품/더블)", "스피디 스키니 브로우"),
    (["페리페라", "peripera"], "[PERIPERA] Speedy Skinny Brow", "Speedy Skinny Brow"),
    (["하쿠호도", "HAKUHODO"], "S191 Eyeliner Brush Round", "S191 Eyeliner Brush Round"),
    (["키스미", "KISS ME"], "[1등브로우]키스미 헤비로테이션 컬러링 아이브로우 EX 6종 (단품/브로우카라기획)", "헤비로테이션 컬러링 아이브로우 EX"),
    (["식물나라"], "식물나라 가벼운 수분 선 젤 60ml 단품/2입 기획", "가벼운 수분 선 젤"),
    (["하트퍼센트"], "[이한 PICK] 하트퍼센트 도트 온 무드 올 커버 립 베이스 4.1g 9종", "도트 온 무드 올 커버 립 베이스"),
    (["메디힐"], "더마 토너 패드 100매 8종 (티트리/마데카소사이드/피디알엔/콜라겐/워터마이드/비타/피토엔자임/레티놀)", "더마 토너 패드"),
    (["어바웃톤", "NEW"], "[촉촉블러쿠션]NEW 어바웃톤 워터 레이어 핏 쿠션 14g 8종 (기획/단품)", "워터 레이어 핏 쿠션"),
    (["웨이크메이크"], "[미니틴트 증정]웨이크메이크 워터 블러링 레이어 틴트 14COLOR(단품/기획)", "워터 블러링 레이어 틴트"),
    (["클리오"], "[6월 올영픽/단종부활템 증정] 클리오 킬 래쉬 수퍼프루프 마스카라 1+1기획 (+미니 속눈썹 영양제 증정)", "킬 래쉬 수퍼프루프 마스카라"),
    (["에스쁘아"], "[핸들 파우치 증정 기획] 에스쁘아 실크 스킨 레이어 쿠션 7colors 본품+리필", "실크 스킨 레이어 쿠션"),
    (["낫포유", "NOT4U", "뿌리는"], "[1위 속보습미스트] 뿌리는 바디로션 낫포유 크림 바디미스트 200ml", "크림 바디미스트"),
    (["넘버즈인"], "[쿨링진정]넘버즈인 1번 진정 맑게담은 청초토너 300ml 리필기획(+300ml 증정)", "1번 진정 맑게담은 청초토너"),
    (["넘버즈인"], "[파데프리] 넘버즈인 3번 도자기결 톤업베이지 선크림 50ml 더블기획 2종 (블러/글로우)", "3번 도자기결 톤업베이지 선크림"),
    (["스킨베네핏"], "스킨베네핏 3종 퀵 커버 헤어 마스카라 듀오팩 (흑갈색/자연갈색/자연흑색) 중 택 1", "퀵 커버 헤어 마스카라 듀오팩"),
    (["넘버즈인"], "[흔적미백] 넘버즈인 5번 글루타치온C 흔적 앰플 30ml+30ml 듀오기획", "5번 글루타치온C 흔적 앰플"),
    (["리쥬더마"], "[리쥬란 제약사_4배속 급속진정]리쥬더마 EX 리페어링 크림 20g (+5g*2ea) 한정기획", "EX 리페어링 크림"),
    (["메디큐브"], "[미백원액세럼][NEW]메디큐브 PDRN 핑크 원데이 세럼(1.5ml*10ea)", "PDRN 핑크 원데이 세럼"),
    (["라보에이치"], "[6월 올영픽/두피선크림] 라보에이치 UV 롤온선세럼15ML+샴푸50증정기획", "UV 롤온선세럼"),
    (["비긴스 바이 정샘물", "비긴스"], "[도훈PICK/7일잡티샷] 비긴스 바이 정샘물 나이아신아마이드10 흔적세럼 리필기획", "나이아신아마이드10 흔적세럼"),
    (["코랄헤이즈"], "코랄헤이즈 글로우락젤리틴트 6종 (기획/단품) *", "글로우락젤리틴트"),
    (["크리니크"], "크리니크 각질케어토너 200ml (피부타입별 선택)", "각질케어토너"),
    (["이지듀"], "[열감진정리페어] 이지듀 EGFx 다운타임 3종 키트 (세럼 40ml+크림60ml+오인트겔5ml)", "EGFx 다운타임 키트"),
    (["힌스"], "[미니 플럼핑 립 펜슬 증정] 힌스 누 블러 틴트 10 Colors 한정 기획", "누 블러 틴트"),
    (["헤어플러스"], "[화해1위] 헤어플러스 단백질 본드 앰플 에센스 70ml(노워시 헤어팩)", "단백질 본드 앰플 에센스"),
    (["헤어플러스"], "[포켓몬 에디션][손상케어] 헤어플러스 단백질 본드 앰플에센스 70ml 2개입 한정/단독기획 (노워시)", "단백질 본드 앰플에센스"),
    (["셀리맥스"], "셀리맥스 대용량 토너패드 기획팩 2종 택1", "대용량 토너패드"),
    (["니들리"], "니들리 데일리 토너 패드 80매 (+20매 증정기획) (OY단독)", "데일리 토너 패드"),
    (["라운드랩"], "[속광탄력/콜라겐팩] 라운드랩 동백 딥 콜라겐 탄력 겔 마스크 4매 (온)", "동백 딥 콜라겐 탄력 겔 마스크"),
    (["원오브뎀"], "[하루종일 착붙] 원오브뎀 드 뗑 쿠션 12g(1호, 2호)", "드 뗑 쿠션"),
    (["에뛰드"], "[NEW 컬러] 에뛰드 드로잉 아이즈 컬러링 브로우카라 (26AD) 8 Colors", "드로잉 아이즈 컬러링 브로우카라"),
    (["뉴트로지나"], "[재구매율1위/보들촉촉밀크] 뉴트로지나 딥클린 클렌징로션(클렌징 밀크) 200ml 2입", "딥클린 클렌징로션"),
    (["홀리카홀리카"], "홀리카홀리카 래쉬코렉팅마스카라 꿀조합 특별한정기획", "래쉬코렉팅마스카라 꿀조합"),
    (["홀리카홀리카"], "홀리카홀리카 래쉬코렉팅케어 에센셜 세럼 (속눈썹영양제)", "래쉬코렉팅케어 에센셜 세럼"),
    (["눅스"], "[고보습 허니 립밤]눅스 레브드미엘 립밤 15g기획 (+핸드앤네일크림15ml 증정)", "레브드미엘 립밤"),
    (["빼바"], "[포켓몬에디션] 빼바 리얼초콜릿 프로틴바 40g 4종 1택 (다크/화이트/쿠키앤크림/그릭요거트)", "리얼초콜릿 프로틴바"),
    (["니베아"], "[NEW/ 피부장벽 2주 개선]니베아 리페어 앤 케어 바디로션 400ml (무향)", "리페어 앤 케어 바디로션"),
    (["메리쏘드"], "메리쏘드 릴타투 벨벳 틴트5종", "릴타투 벨벳 틴트"),
    (["블리스텍스"], "블리스텍스 립 메덱스 립밤 대용량팩 7g (12개입)", "립 메덱스 립밤 대용량팩"),
    (["센텔리안24"], "[진정/속보습] 센텔리안24 마데카 데일리 리페어 앰플 50ml (첫단계진정앰플)", "마데카 데일리 리페어 앰플"),
    (["티르티르"], "[NEW/서옥공동개발] 티르티르 마스크 핏 레드 쿠션 파운데이션 18g 20 colors (AD)", "마스크 핏 레드 쿠션 파운데이션"),
    (["린제이"], "[72관왕/1위] 린제이 매직(앰플) 모델링 팩 (컵팩) 3종 택1", "매직 앰플 모델링 팩"),
    (["엔트로피"], "[필름광] 엔트로피 메이크업 참 틴트(글로시 겔) 10 Colors", "메이크업 참 틴트 글로시 겔"),
    (["일리윤"], "[5년연속1위] 일리윤 세라마이드 아토 로션기획(600ML+600ML)", "세라마이드 아토 로션"),
    (["라운드어라운드"], "[제주한정판매]라운드어라운드 센티드 모이스처라이징 립밤 [제주 감귤]", "센티드 모이스처라이징 립밤 제주 감귤"),
    (["CJ"], "[6월 올영픽/콜라겐] CJ 이너비 글로우앰플 6병 (6일분)", "이너비 글로우앰플"),
    (["아비노"], "[71ml증정] 아비노 바디로션 532ml 단독기획(자몽향)", "바디로션"),
    (["비욘드"], "비욘드 엔젤아쿠아 소프트 페이셜 필링젤 더블기획(100mlX2입)(비건)", "엔젤아쿠아 소프트 페이셜 필링젤"),
    (["아벤느"], "아벤느 이드랑스 아쿠아 크림-인-젤 50ml 기획(에센스인로션25ml+클리낭스젤15ml)(2602)", "이드랑스 아쿠아 크림-인-젤"),
    (["닥터지"], "닥터지 레드 블레미쉬 클리어 수딩 크림 70ml 1+1 교차선택", "레드 블레미쉬 클리어 수딩 크림"),
    (["에스트라"], "에스트라 아토베리어365 크림 80ml 더블기획(80ml+80ml) 교차선택", "아토베리어365 크림"),
    (["라운드랩"], "[수분진정] 라운드랩 1025 독도 토너 500ml 대용량 기획세트 (+100ml 증정)", "1025 독도 토너"),
    (["클리오"], "[단독기획] 클리오 킬커버 파운웨어 쿠션 더 뉴 15g 본품+리필", "킬커버 파운웨어 쿠션 더 뉴"),
    (["투쿨포스쿨"], "[증정기획] 투쿨포스쿨 아트클래스 바이로댕 쉐딩 9.5g+브러쉬", "아트클래스 바이로댕 쉐딩"),
    (["*[고커버/롱래스팅]"], "*[고커버/롱래스팅] 티핏 아이시 핏 커버 쿠션 이엑스 3colors SPF50+ PA++++", "티핏 아이시 핏 커버 쿠션 이엑스"),
    (["리쥬란"], "[모공PDRN] 리쥬란 더마 힐러 포어 타이트닝 앰플 30ml [한정기획(+토너패드2매X6)/단품]_올영픽", "더마 힐러 포어 타이트닝 앰플"),
    (["에스쁘아"], "[1등 더마 BB 크림] 에스쁘아 더마커버 블레미쉬 밤 40g 2colors SPF 50 PA++++", "더마커버 블레미쉬 밤"),
    (["달바"], "[생기톤업] 달바 워터풀 톤업 선크림 65ml + 65ml 대용량 기획세트", "워터풀 톤업 선크림"),
    (["토코보"], "[수분선크림/화잘먹] 토코보 바이오 워터리 선크림 50mL SPF50+ PA++++", "바이오 워터리 선크림"),
    (["라운드랩"], "[NEW] 라운드랩 독도 클렌징 오일 200ml + 독도 클렌저 150ml 기획", "독도 클렌징 오일"),
    (["하다라보"], "[피지제거/말끔결/고보습] 하다라보 고쿠쥰 클렌징 오일 200mL*2 기획", "고쿠쥰 클렌징 오일"),
    (["메이크프렘"], "[뽀용톤업/무기자차] 메이크프렘 수딩 핑크 톤업 선크림 40ml+40ml 기획 (+20ml)", "수딩 핑크 톤업 선크림"),
    (["딘시"], "딘시 프리미엄 비건 블루 톤업 선크림 50ml+20ml 증량기획", "프리미엄 비건 블루 톤업 선크림"),
    (["라보에이치"], "라보에이치 두피강화클리닉 앰플토닉 100ML+100ML리필 기획", "두피강화클리닉 앰플토닉"),
    (["에스쁘아"], "[100시간 지속/고커버] 에스쁘아 비벨벳 커버쿠션 SPF42 PA++ 본품+리필", "비벨벳 커버쿠션"),
    (["아누아"], "[수지pick/화해1위] 아누아 피디알엔 히알루론산 캡슐 100 세럼 1ml*10ea", "피디알엔 히알루론산 캡슐 100 세럼"),
    (["유리아쥬"], "[대용량/단독기획] 유리아쥬 진피 마일드 젤 500ml+진-8 100ml", "진피 마일드 젤"),
    (["다슈"], "[변우석 Pick]다슈 포맨 프리미엄 울트라 본드 젤 다운펌 100ml*2입", "포맨 프리미엄 울트라 본드 젤 다운펌"),
    (["아벤느"], "아벤느 클리낭스 클렌징 젤 200ml*피지잡는 *약산성클렌저 *클렌징폼", "클리낭스 클렌징 젤"),
    (["김정문알로에"], "[증량기획] 김정문알로에 큐어 리알로에 워터 젤리 토너 500ml+50ml [젤리토너]", "큐어 리알로에 워터 젤리 토너"),
    (["버츠비"], "버츠비 석류 립밤 듀오팩 (버츠비 석류 립밤 4.25g x 2)", "석류 립밤 듀오팩"),
    (["오휘"], "오휘 얼티밋 핏 진 쿠션 본품15g+리필15g (롱웨어/톤업)", "얼티밋 핏 진 쿠션"),
    (["바이오힐보", "BIOHEAL BOH"], "[탄력토너] 바이오힐 보 프로바이오덤 3D 리프팅 에센셜 토너 150ml", "프로바이오덤 3D 리프팅 에센셜 토너"),
    (["클리오"], "(클리오X국가유산청) 프로 아이 팔레트 에어", "프로 아이 팔레트 에어"),
    (["포뷰트"], "포뷰트 두피 타투15g 블랙/브라운 단품/기획", "두피 타투"),
    (["캔메이크", "CANMAKE"], "[신상출시/초슬림라이너] 캔메이크 크리미 터치 라이너 10종 택1", "크리미 터치 라이너"),
    (["더샘", "the SAEM"], "Cover Perfection Tip Concealer", "Cover Perfection Tip Concealer"),
    (["비긴스바이정샘물", "비긴스 바이 정샘물", "비긴스"], "[10만나노히알/3초수분플럼핑]비긴스바이정샘물 블루 수국 히알 수분세럼 30ml", "블루 수국 히알 수분세럼"),
    (["려"], "[뿌리볼륨스타일링]려 루트젠 뿌리볼류머 150ML+샴푸증정기획_올영단독한정", "루트젠 뿌리볼류머"),
]
#: The same with a shade.
SHADED = [(["오렌즈", "OLENS"], "글로이 티어 원데이 그레이", "그레이", "글로이 티어 원데이"), (["롬앤", "rom&nd"], "롬앤 베러 댄 쉐입 쉐딩 02 그레이쿨", "02 그레이쿨", "베러 댄 쉐입 쉐딩")]
#: What has no name, is all noise, or holds signs of patterns.
ODD = [
    (None, None, None, None),
    ("  ", ["a"], None, None),
    ("[세트]", ["a"], None, "[세트]"),
    ("Brand", ["Brand"], None, "Brand"),
    ("A.B+C* \\E cream (x)", ["A.B+C* \\E", None], [None, "", "x"], "cream x"),
    ("AxB+C* cream", ["A.B+C*"], None, "AxB+C* cream"),
    ("cream 3종 kit", None, None, "cream"),
    ("3종 ab", None, None, "3종 ab"),
    ("brand   brand | BRAND\tcream", ["brand"], None, "cream"),
    ("x red", None, ["red"], "x red"),
    ("3 colors lipstick [3 pcs] gloss", None, None, "3 colors lipstick"),
    ("lip" + " [10ml]" * 300 + " 10ml" * 200, None, None, "lip" + " 10ml" * 299),
]


def shown(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, aliases array<string>, variants array<string>")
    return [r["d"] for r in df.repartition(3).select("id", names.display_name(F.col("name"), F.col("aliases"), F.col("variants")).alias("d")).orderBy("id").collect()]


def test_golden_names(spark):
    rows = [(n, a, None, want) for a, n, want in GOLDEN] + [(n, a, [s], want) for a, n, s, want in SHADED]
    assert shown(spark, [r[:3] for r in rows]) == [r[3] for r in rows]


def test_names_that_are_odd(spark):
    assert shown(spark, [r[:3] for r in ODD]) == [r[3] for r in ODD]


def test_names_do_not_change_twice(spark):
    """The fixpoint is one: without brackets left, cleaning a cleaned name changes nothing."""
    once = shown(spark, [(n, a, None) for a, n, _ in GOLDEN])
    assert shown(spark, [(n, a, None) for n, (a, *_) in zip(once, GOLDEN)]) == once


def test_brand_names_of_records(spark):
    df = spark.createDataFrame([("바이오힐 보", "BIOHEAL  boh", ["BIOHEAL BOH", None, "바이오힐보"]), (None, "려 a", None), (None, None, None)], "ko string, en string, more array<string>")
    got = [r[0] for r in df.select(names.brand_names([F.col("ko"), F.col("en")], F.col("more"))).collect()]
    assert got == [["바이오힐보", "바이오힐 보", "BIOHEAL boh"], ["려 a"], []]


@pytest.mark.parametrize("seed", [1, 2])
def test_types_are_translated_once_by_the_longest(spark, seed):
    rng = random.Random(seed)
    parts = [t for t, _ in names.TYPE_TERMS] + [" ", "x", "가", "Aqua ", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(400)] + [None]

    def by_hand(t):
        t = " ".join((t or "").split())
        for term, english in sorted(names.TYPE_TERMS, key=lambda x: -len(x[0])):
            if term in t:
                out = " ".join(t.replace(term, english).split())
                return None if any("가" <= c <= "힣" for c in out) else out
        return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r["e"] for r in df.select("id", names.translated_type(F.col("t")).alias("e")).orderBy("id").collect()]
    assert got == [by_hand(t) for t in texts]
    assert sum(x is not None for x in got) > 20


RECORD = "source_brand_name string, source_brand_name_en string, product_name_ko string, product_name_en string, product_name_display_ko string, product_name_display_en string, shade string"
REST = {"canonical_product_id": "string", "category": "string", "currency": "string", "image_url": "string", "description": "string", "source_url": "string", "source_product_id": "string", "source": "string", "updated_at": "string", "regular_price": "double", "original_price": "double", "sale_price": "double", "rating": "double", "review_count": "int", "sold_out": "boolean"}


@pytest.mark.parametrize("literals", [1000, 1])
def test_records_get_brands_and_display_names(spark, literals, monkeypatch):
    """Brands of the name by alias, by initials and by a second table; names cleaned of every spelling of the brand."""
    monkeypatch.setattr(normalize, "ALIAS_LITERALS", literals)
    registry = [("BEGINS BY JUNGSAEMMOOL", "비긴스 바이 정샘물"), ("BEGINS BY JUNGSAEMMOOL", "비긴스"), ("ETUDE", "에뛰드"), ("ETUDE", "ETUDE"), ("NOT4U", "낫포유"), ("rom&nd", "롬앤"), ("rom&nd", "rom&nd")]
    aliases = normalize.alias_table(spark.createDataFrame([(o, a, i) for i, (o, a) in enumerate(registry)], "official_en string, alias string, position int"))
    external = normalize.alias_table(spark.createDataFrame([("TEST BRAND", "테스트브랜드", 0), ("한글", "무명", 1)], "official_en string, alias string, position int"))
    rows = [
        (("비긴스", None, "[1]비긴스바이정샘물 수국 세럼 30ml", None, None, None, None), ("비긴스 바이 정샘물", "BEGINS BY JUNGSAEMMOOL", "수국 세럼", None)),
        (("비긴스바이정샘물", None, "비긴스 바이 정샘물 흔적 세럼", None, None, None, None), ("비긴스 바이 정샘물", "BEGINS BY JUNGSAEMMOOL", "흔적 세럼", None)),
        (("뿌리는", None, "뿌리는 낫포유 크림 200ml", None, None, None, None), ("낫포유", "NOT4U", "크림", "Cream")),
        ((None, None, "[특가] 에뛰ㄷ 립밤", None, None, None, None), ("에뛰드", "ETUDE", "에뛰ㄷ 립밤", None)),
        (("롬엔", None, "롬엔 베러 팔레트 02 그레이", "rom&nd Better Palette", None, None, "02 그레이"), ("롬엔", "rom&nd", "베러 팔레트", "Better Palette")),
        (("테스트브랜드", None, "테스트브랜드 제품", None, None, None, None), ("테스트브랜드", "TEST BRAND", "제품", None)),
        (("무명", None, "무명 제품", None, None, None, None), ("무명", None, "제품", None)),
        (("BRTC", "BRTC", None, "BRTC Aqua 3 set", "손질한 이름", None, None), (None, "BRTC", "손질한 이름", "Aqua")),
        (("*[고커버]", None, "*[고커버] 선스틱 기획", None, None, None, None), (None, None, "선스틱", "Sun Stick")),
        ((None,) * 7, (None,) * 4),
    ]
    frame = spark.createDataFrame([(*r, i) for i, (r, _) in enumerate(rows)], RECORD + ", id int")
    frame = frame.withColumns({c: F.lit(None).cast(t) for c, t in REST.items()}).withColumns({"source_product_id": F.col("id").cast("string"), "options": F.array(F.lit(" a  b "), F.lit(" "))})
    made = normalize.normalize_records(frame, aliases, "https://shop.example/", external).collect()
    got = {int(r["source_product_id"]): (r["brand_ko"], r["brand_en"], r["product_name_display_ko"], r["product_name_display_en"]) for r in made}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
    assert {tuple(r["options"]) for r in made} == {("a b",)}
    assert normalize.normalize_records(frame.limit(0), aliases, "https://shop.example/").collect() == []
