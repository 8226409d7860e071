"""Column functions for text: cleaning, prices, URLs, scripts, tokens, n-grams. All are JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literal replacements of the search key, applied in this order.
TEXT_REPLACEMENTS: tuple[tuple[str, str], ...] = (
    ("브러쉬", "브러시"),
    ("brush", "브러시"),
    ("eyeliner", "아이라이너"),
    ("eye liner", "아이라이너"),
    ("eye shadow", "아이섀도"),
    ("eye-shadow", "아이섀도"),
    ("eyeshadow", "아이섀도"),
    ("쉐딩", "섀딩"),
    ("셰딩", "섀딩"),
    ("gray", "그레이"),
    ("grey", "그레이"),
    ("sunscreen", "선크림"),
    ("sun cream", "선크림"),
    ("sun-cream", "선크림"),
    ("sun block", "선크림"),
    ("sunblock", "선크림"),
    ("sun serum", "선세럼"),
    ("sun stick", "선스틱"),
    ("body lotion", "바디로션"),
    ("body-lotion", "바디로션"),
    ("body wash", "바디워시"),
    ("skin lotion", "스킨로션"),
    ("skin-lotion", "스킨로션"),
    ("lotion", "로션"),
    ("foundation", "파운데이션"),
    ("foundations", "파운데이션"),
    ("lip tint", "립틴트"),
    ("lip-tint", "립틴트"),
    ("gloss", "글로스"),
    ("lip gloss", "립글로스"),
    ("lip-gloss", "립글로스"),
    ("lip balm", "립밤"),
    ("lipstick", "립스틱"),
    ("lip stick", "립스틱"),
    ("vitamin c", "비타민씨"),
    ("vitamin-c", "비타민씨"),
    ("serum", "세럼"),
    ("ampoule", "앰플"),
    ("ampule", "앰플"),
    ("essence", "에센스"),
    ("toner", "토너"),
    ("moisturizer", "크림"),
    ("eye cream", "아이크림"),
    ("night cream", "나이트크림"),
    ("sleeping pack", "슬리핑팩"),
    ("sheet mask", "마스크팩"),
    ("mask pack", "마스크팩"),
    ("face mask", "마스크팩"),
    ("foam cleanser", "폼클렌저"),
    ("face wash", "폼클렌저"),
    ("cleansing oil", "클렌징오일"),
    ("cleansing balm", "클렌징밤"),
    ("cleansing milk", "클렌징밀크"),
    ("cleanser", "클렌저"),
    ("cleansing", "클렌징"),
    ("scrub", "스크럽"),
    ("exfoliant", "필링젤"),
    ("peeling gel", "필링젤"),
    ("mist", "미스트"),
    ("facial oil", "페이스오일"),
    ("face oil", "페이스오일"),
    ("bb cream", "비비크림"),
    ("cc cream", "CC크림"),
    ("cushion", "쿠션"),
    ("primer", "프라이머"),
    ("concealer", "컨실러"),
    ("contour", "컨투어링"),
    ("blusher", "블러셔"),
    ("blush", "블러셔"),
    ("highlighter", "하이라이터"),
    ("mascara", "마스카라"),
    ("eyebrow", "눈썹"),
    ("eye brow", "눈썹"),
    ("brow pencil", "브로우펜슬"),
    ("brow mascara", "브로우마스카라"),
    ("setting powder", "세팅파우더"),
    ("loose powder", "루스파우더"),
    ("setting spray", "세팅스프레이"),
    ("lip liner", "립라이너"),
    ("lip color", "립스틱"),
    ("lipcolor", "립스틱"),
)

#: Further replacements of the service key, applied after the search key.
SERVICE_REPLACEMENTS: tuple[tuple[str, str], ...] = (
    ("glowy", "글로이"),
    ("tear", "티어"),
    ("비타민씨", "비타"),
    ("여백살롱", "여백카롱"),
    ("및서재", "밑서재"),
    ("플로팅", "플러팅"),
    ("이즈핏", "이지핏"),
    ("땡큐요엠핑크", "요염핑"),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside higher-order functions an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; an empty text becomes null (F1)."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def casefold(c: Column) -> Column:
    """Lower case with sharp s written out, the one common letter whose folding lower case misses."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _digits(c: Column) -> Column:
    found = F.regexp_extract(clean_text(c), r"(\d[\d,]*)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("bigint")


def parse_krw_display_price(c: Column) -> Column:
    """The first run of digits and commas as a number, else null."""
    return _digits(c)


def parse_krw_price(c: Column) -> Column:
    """As :func:`parse_krw_display_price`, but a range or a "from" price has no value (F2)."""
    return F.when(~(c.contains("~") | c.contains("부터")), _digits(c))


def absolute_url(c: Column, base: str) -> Column:
    """An absolute URL (F4): ``//`` gets https, paths from the root or beside the base are joined to it.

    Dot segments are kept as they are.
    """
    text = clean_text(c)
    scheme, _, rest = base.partition("://")
    host, _, path = rest.partition("/")
    root, folder = f"{scheme}://{host}", "/" + path.rpartition("/")[0] + "/" * bool(path.rpartition("/")[0])
    return (
        F.when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text)
        .when(text.startswith("/"), F.concat(F.lit(root), text))
        .when(text.isNotNull(), F.concat(F.lit(root + folder), text))
    )


def has_hangul(c: Column) -> Column:
    return F.coalesce(c.rlike("[가-힣]"), F.lit(False))


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def name_language(c: Column) -> Column:
    """ko, latin, mixed or unknown."""
    ko, latin = has_hangul(c), has_latin(c)
    return F.when(ko & latin, "mixed").when(ko, "ko").when(latin, "latin").otherwise("unknown")


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Literal replacements in order. They are nested inside one :func:`let`: generated code of some eighty calls, repeated
    for each key of a plan, would outgrow a method, and a fold over an array of pairs takes three times as long."""
    return let(c, lambda x: reduce(lambda text, p: F.replace(text, F.lit(p[0]), F.lit(p[1])), pairs, x))


def canonical_text(c: Column) -> Column:
    """Cleaned, folded text with the ordered replacements (F7); null becomes empty."""
    return _replaced(F.coalesce(casefold(clean_text(c)), F.lit("")), TEXT_REPLACEMENTS)


def search_key(c: Column) -> Column:
    """K1: canonical text without white space and punctuation."""
    return F.regexp_replace(canonical_text(c), r"(?U)[\s\-_./|+&'():\[\],]+", "")


def service_key(c: Column) -> Column:
    """K2: search key with the service's replacements."""
    return _replaced(search_key(c), SERVICE_REPLACEMENTS)


def service_key_of(word: str) -> str:
    """K2 of a fixed word, computed once on the driver instead of in each row."""

    def replaced(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
        return reduce(lambda t, p: t.replace(*p), pairs, text)

    key = re.sub(r"[\s\-_./|+&'():\[\],]+", "", replaced(" ".join(word.split()).lower().replace("ß", "ss"), TEXT_REPLACEMENTS))
    return replaced(key, SERVICE_REPLACEMENTS)


def brand_key(c: Column) -> Column:
    """K3: cleaned text without blanks, hyphens, low lines, stops and slashes, folded."""
    return casefold(F.regexp_replace(F.coalesce(clean_text(c), F.lit("")), r"(?U)[\s\-_./]+", ""))


def normalizer_key(c: Column) -> Column:
    """K4."""
    return casefold(F.regexp_replace(F.coalesce(clean_text(c), F.lit("")), r"(?U)[\s\-_./&|#·ㆍ:：,()\[\]]+", ""))


def display_key(c: Column) -> Column:
    """K5: Latin letters, digits and Hangul only, folded."""
    return casefold(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z가-힣]+", ""))


def latin_key(c: Column) -> Column:
    """K6."""
    return F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    """Alphanumeric and Hangul tokens, folded."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0)), casefold)


def compact_ngrams(key: Column, least: int = 2, most: int = 8) -> Column:
    """The key and all its n-grams of ``least`` to ``most`` characters, by size, then place (F11); ``key`` is a search key."""

    def grams(k: Column) -> Column:
        n = F.length(k)
        sizes = F.sequence(F.lit(least), F.least(F.lit(most), n))
        made = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.substring(k, i, s))))
        return F.when(n >= least, F.concat(F.array(k), made)).otherwise(F.array().cast("array<string>"))

    return let(key, grams)


def dedupe_texts(texts: Column) -> Column:
    """Trimmed texts without empty ones and without those whose folded form came before (F15, folded form)."""
    kept = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    pairs = F.transform(kept, lambda t: F.struct(casefold(t).alias("key"), t.alias("text")))

    def first_of_each(p: Column) -> Column:
        # array_distinct keeps first occurrences; equal keys with other spellings are looked up at their first place.
        return let(p["key"], lambda keys: F.transform(F.array_distinct(keys), lambda k: F.element_at(p["text"], F.array_position(keys, k).cast("int"))))

    return let(pairs, first_of_each)


def query_terms(c: Column, most: int = 32) -> Column:
    """Terms that a query is looked up by: tokens, key and 2- to 4-grams of two characters or more, the first 32."""

    def terms(key: Column) -> Column:
        return F.concat(tokens(c), F.array(key), compact_ngrams(key, 2, 4))

    return F.slice(dedupe_texts(F.filter(let(search_key(c), terms), lambda t: F.length(t) >= 2)), 1, most)


def sale_price_if_discounted(sale: Column, original: Column) -> Column:
    """The sale price where it is below the original price (F16)."""
    return F.when(sale.isNotNull() & (original.isNull() | (sale < original)), sale)


def parse_number(c: Column) -> Column:
    """A double from text with thousands commas (F17, exports); else null."""
    return F.replace(clean_text(c), F.lit(","), F.lit("")).try_cast("double")


def parse_whole_number(c: Column) -> Column:
    """The whole part of :func:`parse_number`."""
    return parse_number(c).cast("bigint")


def payload_int(c: Column) -> Column:
    """All digits of a text as one number (F17, payloads)."""
    return F.regexp_replace(c, r"\D", "").try_cast("bigint")


def payload_float(c: Column) -> Column:
    """A double whose comma is a decimal point (F17, payloads)."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def parse_bool(c: Column) -> Column:
    """Words for sold out and for available as true and false, else null."""
    word = casefold(clean_text(c))
    true, false = ("true", "t", "1", "yes", "y", "sold_out", "soldout"), ("false", "f", "0", "no", "n", "available", "in_stock", "instock")
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def parse_options(c: Column) -> Column:
    """Options from a JSON list, or from text parted by ``|`` where it isn't JSON (F17); null without any."""
    text = clean_text(c)
    listed = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("["), F.coalesce(listed, F.split(text, r"\|"))).otherwise(F.split(text, r"\|"))
    cleaned = F.filter(F.transform(parts, clean_text), lambda t: t.isNotNull())
    return F.when(F.size(cleaned) > 0, cleaned)


def sold_out_from_status(c: Column) -> Column:
    """Stock status words as sold out or not."""
    word = casefold(clean_text(c))
    gone = word.contains("sold_out") | word.contains("out_of_stock") | word.contains("품절")
    return F.when(gone, True).when(word.contains("in_stock") | word.contains("available") | word.contains("판매중"), False)


def rating_from_text(c: Column) -> Column:
    """A rating from 0 to 5 before 점 or a slash."""
    return F.replace(F.nullif(F.regexp_extract(c, r"([0-5](?:[.,]\d)?)\s*(?:점|/)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def review_count_from_text(c: Column) -> Column:
    """The first number of a text that speaks of reviews."""
    number = F.replace(F.regexp_extract(c, r"([\d,]+)\s*(?:건|개)?", 1), F.lit(","), F.lit("")).try_cast("bigint")
    return F.when(c.contains("리뷰") | casefold(c).contains("review"), number)


def brand_from_name(c: Column) -> Column:
    """The first word of a name after its leading ``[badges]``, null without one."""
    bare = clean_text(F.regexp_replace(c, r"^(\s*\[[^\]]*\]\s*)+", ""))
    return F.nullif(F.element_at(F.split(bare, " "), 1), F.lit(""))


def is_positive_price(c: Column) -> Column:
    """Whether the digits and stops of a price text are a number above zero."""
    number = F.trim(F.regexp_replace(c, r"[^\d.]", ""))
    return F.coalesce(F.regexp_replace(number, r"^\.+|\.+$", "").try_cast("double") > 0, F.lit(False))


def is_usable_image_url(c: Column) -> Column:
    """Whether an image URL is absolute and its scheme isn't doubled."""
    return F.coalesce(c.rlike("^https?://") & ~c.rlike("^(https:https://|http:http://)"), F.lit(False))


def source_from_url(c: Column) -> Column:
    """The source that a URL belongs to, null for others."""
    url = casefold(c)
    found = F.lit(None).cast("string")
    for name in reversed(("oliveyoung", "musinsa", "coupang", "hwahae", "glowpick", "fudejapan")):
        found = F.when(url.contains(name), name).otherwise(found)
    return found


def batch_lines(c: Column) -> Column:
    """Lines of a pasted text without bullets and numbering, cleaned, each once by its folded form (F28); the trimmed text if there is none."""
    bare = F.transform(F.split(c, r"\r\n|[\n\r]"), lambda x: clean_text(F.regexp_replace(x, r"^\s*(?:[-*•]+|\d+[.)])\s*", "")))
    lines = dedupe_texts(bare)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.trim(c)))


def without_brand(query: Column, alias: Column) -> Column:
    """A query with a blank instead of the first mention of a brand, whatever its case."""
    place = F.instr(casefold(query), casefold(alias))
    rest = F.concat(F.substring(query, F.lit(1), place - 1), F.lit(" "), F.substring(query, place + F.length(alias), F.length(query)))
    return F.coalesce(clean_text(F.when((F.coalesce(alias, F.lit("")) == "") | (place == 0), query).otherwise(rest)), F.lit(""))


# Patterns of a product id in a URL and in a click handler, of shade mentions, and words that mark an option's
# text as no shade.
PRODUCT_ID_URL = r"goodsNo=([A-Z0-9]+)"
PRODUCT_ID_HANDLER = r"moveGoodsDetail\(['\"]([A-Z0-9]+)['\"]"
SHADE = (
    r"(?:#?\d{1,3}\s*(?:호|번|\.|-)?\s*[가-힣A-Za-z0-9][^,\n/|]{0,36}|"
    r"[가-힣A-Za-z0-9]+\s*(?:핑크|레드|코랄|베이지|브라운|누드|로즈|오렌지|라벤더|아이보리|블랙|화이트|그레이))"
)
OPTION_NOISE = ("상품을 선택", "품절", "선택", "옵션", "구매불가", "재입고", "장바구니", "바로구매")


def product_id_in(c: Column) -> Column:
    """A product id from a URL or a click handler, null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (PRODUCT_ID_URL, PRODUCT_ID_HANDLER)))


def shade_mentions(options: Column, most: int = 12) -> Column:
    """The shades that option texts mention, each once, the first ``most`` joined by commas; null without any."""

    def noise(t: Column) -> Column:
        return F.exists(F.array(*map(F.lit, OPTION_NOISE)), lambda w: F.contains(t, w))

    plain = F.filter(F.transform(options, clean_text), lambda t: t.isNotNull() & ~noise(t))
    found = F.flatten(F.transform(plain, lambda t: F.transform(F.regexp_extract_all(t, F.lit(SHADE), F.lit(0)), clean_text)))
    return F.nullif(F.array_join(F.slice(dedupe_texts(F.filter(found, lambda t: ~noise(t))), 1, most), ", "), F.lit(""))
