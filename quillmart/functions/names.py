"""Display names: a rewrite system over column expressions that strips retail noise, brands, sizes and variants (F22),
and the translation of one product-type term (F23)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmart.functions.text import casefold, clean_text, has_hangul, let, normalizer_key

# The words and shapes of retail noise. Letters are compared in either case. Texts are clean (single
# blanks), so ``\s`` means a blank. A pattern that begins with a group keeps what the group holds.

_SIZE = r"\d+(?:\.\d+)?\s*(?:g|ml)"
_SIZED = r"\d+(?:\.\d+)?\s*(?:g|ml|매|개)"
_COLORS = r"(?:colors?|컬러)"
_PA = r"PA\+{1,4}"
_SPF = rf"SPF\s*\d+\+?(?:\s*/\s*{_PA}|\s+{_PA})?"
_LETTER = r"([가-힣A-Za-z])"

#: A tag at the head, one in square brackets (repeated) or one in round ones, and words of offers.
HEAD_BRACKETS = r"^(?:\s*[\[【][^\]】]+[\]】]\s*)+"
HEAD_PARENTHESES = r"^\s*[(（][^)）]+[)）]\s*"
HEAD_OFFERS = r"^\s*(?:NEW\s*컬러|신규\s*컬러|올영\s*단독|OY\s*단독|신상|NEW)\s+"
HEAD_DELIMITERS = r"^\s*[|/·ㆍ:：,\-]+\s*"
HEAD_COUNT = r"^\s*\d+\s*종\s+"
#: What may stand before a brand, and what marks it as noise.
BEFORE_BRAND, BRAND_NOISE = r"^\s*([^()\[\]{}]{1,24}?)\s+", r"(?:^|\s)(?:NEW|뿌리는|바르는|올영\s*단독|단독|기획)(?:\s|$)"
AFTER_BRAND = r"(?:\s*\|\s*|\s+|$)"

COUNT_PHRASES = ((r"\s+\d+\s*종\s+키트$", " 키트"), (r"\s+\d+\s*종\s+피부\s*고민별\s*골라담기$", ""), (r"\s+\d+\s*종\s+골라담기$", ""))

PARENTHESES = (
    r"\s*[(（][^)）]*(?:기획|단품|더블|세트|증정|택\s*1|컬러|colors?|선택|\+|리필|본품|대용량|한정|/)[^)）]*[)）]",
    r"\s*[(（]\s*\d+(?:\.\d+)?\s*(?:g|ml|ea|매|개|개입)\s*(?:[*x]\s*\d+\s*(?:ea|매|개|개입)?)?\s*[)）]",
    rf"\s*[(（][^()\[\]{{}}]*{_SIZE}\s*x\s*\d+[^()\[\]{{}}]*[)）]",
    r"\s*[(（][^()\[\]{}]*(?:OY\s*단독|노워시|클렌징\s*밀크|애교살|섀도우|브로우펜슬|브로우마스카라|속눈썹\s*영양제|무향|라벤더향|첫단계\s*진정\s*앰플|컵팩|호\s*,|26AD|AD|NEW)[^()\[\]{}]*[)）]\s*$",
    r"\s*[(（]\s*온\s*[)）]\s*$",
)
BRACKETS = r"\s*[\[【][^\]】]*(?:기획|단품|한정|증정|리필|본품|\+|/)[^\]】]*[\]】](?:_?올영픽)?"

PACKAGING = (
    rf"\s+{_SIZE}\s+\d+\s*{_COLORS}\s+SPF\s*\d+.*$",
    rf"\s+{_SIZE}\s*(?:{_SPF}|{_PA}).*$",
    rf"\s*SPF\s*\d+\+?\s*,?(?:\s*/\s*{_PA}|\s+{_PA}|\s*,\s*{_PA})?(?:\s+\S.*)?$",
    rf"\s*(?:{_SPF}|{_PA})\s*$",
    r"\s+\d+\s*매\s+\d+\s*종$",
    r"\s+\d+\s*병\s+\d+\s*일분$",
    r"\s+\d+\s*(?:colors?|컬러|종)(?:\s*(?:택\s*1|단품|기획|세트|본품\s*\+\s*리필|본품|리필).*)?\s*\*?$",
    rf"{_LETTER}\d+\s*(?:colors?|컬러|종)$",
    rf"\s+\d+\s*{_COLORS}\s+한정(?:\s*기획)?$",
    r"\s+\d+\s*\+\s*\d+\s*기획$",
    r"\s+\d+\s*종\s*1택$",
    rf"\s+{_SIZED}\s+\d+\s*\+\s*\d+\s*(?:교차\s*선택|기획|한정\s*기획|단독\s*기획).*$",
    rf"\s+{_SIZED}\s+(?:대용량\s*)?(?:더블\s*기획|기획\s*세트|단독\s*기획)(?:\s+.*)?$",
    rf"\s+본품\s*{_SIZE}\s*\+\s*리필\s*{_SIZE}$",
    rf"\s+{_SIZE}\s*본품\s*\+\s*리필(?:\s+.*)?$",
    rf"\s+{_SIZE}\s*\+\s*(?:브러쉬|브러시|퍼프|리필|본품|미니|샘플|증정).*$",
    rf"\s+{_SIZE}\s*\+\s*[A-Za-z가-힣0-9\s]+$",
    rf"\s+{_SIZE}\s*\+\s*[A-Za-z가-힣0-9-]+$",
    rf"\s+{_SIZE}\s*(?:x\s*)?\d+\s*입$",
    rf"\s+{_SIZE}\s*[*x]\s*\d+\s*(?:ea|입)?$",
    rf"\s+{_SIZE}\s*\*[A-Za-z가-힣0-9\s*]+$",
    rf"{_LETTER}{_SIZE}\s*[*x]\s*\d+\s*(?:ea|입)?$",
    rf"\s+{_SIZE}\s*x\s*\d+\s*$",
    rf"\s+{_SIZE}\s*/\s*{_SIZE}$",
    rf"\s+{_SIZE}\s*\+\s*{_SIZE}\s+[A-Za-z가-힣0-9\s]+$",
    rf"\s+{_SIZE}\s+증량$",
    rf"\s*{_SIZE}\s*기획$",
    rf"\s*{_SIZE}(?:\s*\+\s*{_SIZE})+$",
    rf"\s*{_SIZE}\s*\+\s*$",
    rf"\s*{_SIZE}\s*\+\s*{_SIZE}\s*(?:증량|대용량|증정)?$",
    r"\s+\d+(?:\.\d+)?\s*(?:g|ml|매)\s+\d+\s*입$",
    rf"\s+{_SIZE}\s+\d+\s*개입\s*(?:한정|단독|기획|/)+.*$",
    rf"\s*{_SIZE}\s*\+\s*[A-Za-z가-힣0-9]+\s*증정기획$",
    rf"\s*{_SIZE}\s*\+\s*[A-Za-z가-힣0-9]+\s*증정\s*기획(?:_?올영(?:단독)?한정)?$",
    rf"\s*{_SIZE}(?:\s*\+\s*\d+(?:\.\d+)?\s*(?:g|ml)?)?\s*(?:듀오|한정)\s*기획$",
    rf"\s+{_SIZED}\s+(?:리필\s*기획|더블\s*기획|기획)(?:\s+\d+\s*종)?$",
    r"\s+(?:중\s*)?택\s*1.*$",
    r"\s+(?:단품|더블|기획|기획팩|기획세트|단독기획|세트|본품|리필|리필기획|증정기획|더블기획|더블기획세트|한정기획|특별한정기획|듀오기획)(?:[/\s].*)?$",
    rf"{_LETTER}기획(?:\s*\+\s*\d+(?:\.\d+)?\s*(?:g|ml)?)?$",
    r"\s+블랙/브라운\s*(?:단품|기획).*$",
    r"\s+기획/단품$",
    r"\s+\d+\s*pcs?(?:\s+.*)?$",
    r"\s+\d+\s*pieces?(?:\s+.*)?$",
    r"\s+\d+\s*items?$",
    r"\s+\d+\s*sets?$",
    r"\s+\d+\s*packs?$",
    r"\s*\[\s*\d+\s*pcs?\s*\].*$",
    r"\s*\(\s*\d+\s*pcs?\s*\).*$",
    rf"{_LETTER}\s*\d+\s*pcs?$",
)
SIZES = (
    rf"\s+{_SIZED}\s+\d+\s*(?:colors?|컬러|종)$",
    rf"\s*{_SIZED}\s+[A-Za-z가-힣]+/[A-Za-z가-힣]+$",
    rf"\s+{_SIZED}$",
    rf"{_LETTER}{_SIZE}$",
)
#: After the fixpoint: what brackets hold is kept without them, and what has become a suffix by that goes.
UNWRAPPED = (r"\s*[(（]\s*([^()\[\]{}]+?)\s*[)）]\s*", r"\s*[\[【]\s*([^\[\](){}]+?)\s*[\]】]\s*")
FLATTENED = (
    r"\s+\d+\s*colors?\s+SPF\s*\d+.*$",
    r"\s+\d+\s*매\s+\d+\s*종(?:\s+.*)?$",
    r"\s+\d+\s*종(?:\s+.*)?$",
    r"\s+\d+\s*병\s+\d+\s*일분$",
    rf"\s+{_SIZE}\s*\+\s*{_SIZE}\s+[A-Za-z가-힣0-9\s]+$",
    r"\s+(?:단독기획|더블기획|기획)\s+.*$",
)
#: What stands before a variant at the end of a name.
BEFORE_VARIANT = r"(?:\s+|[\s/#\-_·ㆍ:：,(\[]+)"
#: A name keeps its count or variant if less than so much of its key (K4) would be left.
LEAST_KEY = 4

#: Product-type terms and their English names.
TYPE_TERMS: tuple[tuple[str, str], ...] = (
    ("슬리핑팩", "Sleeping Pack"),
    ("수분크림", "Moisturizer"),
    ("젤크림", "Gel Cream"),
    ("아이크림", "Eye Cream"),
    ("클렌징오일", "Cleansing Oil"),
    ("클렌징밤", "Cleansing Balm"),
    ("클렌징밀크", "Cleansing Milk"),
    ("클렌징워터", "Micellar Water"),
    ("폼클렌저", "Foam Cleanser"),
    ("클렌징폼", "Cleansing Foam"),
    ("클렌저", "Cleanser"),
    ("클렌징", "Cleansing"),
    ("마스크팩", "Sheet Mask"),
    ("시트마스크", "Sheet Mask"),
    ("필링젤", "Peeling Gel"),
    ("나이트크림", "Night Cream"),
    ("에센스", "Essence"),
    ("앰플", "Ampoule"),
    ("세럼", "Serum"),
    ("토너", "Toner"),
    ("스킨", "Toner"),
    ("미스트", "Mist"),
    ("크림", "Cream"),
    ("로션", "Lotion"),
    ("오일", "Oil"),
    ("스크럽", "Scrub"),
    ("자외선차단제", "Sunscreen"),
    ("선쿠션", "Sun Cushion"),
    ("선세럼", "Sun Serum"),
    ("선스틱", "Sun Stick"),
    ("선스크린", "Sunscreen"),
    ("선크림", "Sunscreen"),
    ("비비크림", "BB Cream"),
    ("씨씨크림", "CC Cream"),
    ("파운데이션", "Foundation"),
    ("쿠션", "Cushion Foundation"),
    ("프라이머", "Primer"),
    ("컨실러", "Concealer"),
    ("컨씰러", "Concealer"),
    ("세팅파우더", "Setting Powder"),
    ("루스파우더", "Loose Powder"),
    ("파우더", "Powder"),
    ("하이라이터", "Highlighter"),
    ("블러셔", "Blush"),
    ("블러시", "Blush"),
    ("볼터치", "Blush"),
    ("치크", "Blush"),
    ("섀딩", "Contour"),
    ("아이섀도우", "Eyeshadow"),
    ("아이섀도", "Eyeshadow"),
    ("아이라이너", "Eyeliner"),
    ("마스카라", "Mascara"),
    ("브로우마스카라", "Brow Mascara"),
    ("브로우펜슬", "Brow Pencil"),
    ("아이브로우", "Eyebrow"),
    ("눈썹", "Eyebrow"),
    ("립글로스", "Lip Gloss"),
    ("립틴트", "Lip Tint"),
    ("립스틱", "Lipstick"),
    ("립밤", "Lip Balm"),
    ("립라이너", "Lip Liner"),
    ("바디로션", "Body Lotion"),
    ("바디크림", "Body Cream"),
    ("바디워시", "Body Wash"),
    ("바디오일", "Body Oil"),
)


def _replaced(t: Column, pattern: str | Column, by: str = "") -> Column:
    pattern = F.concat(F.lit("(?iu)"), pattern) if isinstance(pattern, Column) else F.lit("(?iu)" + pattern)
    return F.regexp_replace(t, pattern, F.lit(by))


def _stripped(t: Column, patterns: Sequence[str]) -> Column:
    """Every pattern in turn taken off; what the first group of ``_LETTER`` holds stays."""
    for p in patterns:
        t = _replaced(t, p, "$1" if p.startswith(_LETTER) else "")
    return t


def literal(c: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([\p{Punct}])", r"\\$1")


def _longest_first(words: Column) -> Column:
    """The words that are not null, the longest first, and of equally long ones the first."""
    numbered = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.sort_array(F.filter(numbered, lambda s: s["w"].isNotNull())), lambda s: s["w"])


def brand_patterns(aliases: Column) -> Column:
    """Patterns of brand names, the longest name first; blanks may stand between the letters of a Hangul name without any."""

    def pattern(alias: Column) -> Column:
        letters = F.filter(F.split(alias, ""), lambda x: x != "")
        return F.when(has_hangul(alias) & ~F.contains(alias, F.lit(" ")), F.array_join(F.transform(letters, literal), r"\s*")).otherwise(literal(alias))

    return F.transform(_longest_first(F.transform(aliases, clean_text)), pattern)


def variant_patterns(variants: Column) -> Column:
    """Patterns of variants of two characters or more at the end of a name, the longest first."""
    named = F.filter(_longest_first(F.transform(variants, clean_text)), lambda v: F.length(v) >= 2)
    return F.transform(named, lambda v: F.concat(F.lit(BEFORE_VARIANT), literal(v), F.lit(r"[)\]]?\s*$")))


def _no_brand(t: Column, brands: Column) -> Column:
    return F.reduce(brands, t, lambda now, b: _replaced(_replaced(now, F.concat(F.lit(r"^\s*"), b, F.lit(AFTER_BRAND))), HEAD_DELIMITERS))


def _no_noise_before_brand(t: Column, brands: Column) -> Column:
    def once(now: Column, b: Column) -> Column:
        pattern = F.concat(F.lit(BEFORE_BRAND), b, F.lit(AFTER_BRAND))
        before = F.call_function("regexp_extract", now, F.concat(F.lit("(?iu)"), pattern), F.lit(1))
        return F.when(F.rlike(before, F.lit("(?iu)" + BRAND_NOISE)), _replaced(_replaced(now, pattern), HEAD_DELIMITERS)).otherwise(now)

    return F.reduce(brands, t, once)


def _if_enough(t: Column, change: Callable[[Column], Column]) -> Column:
    return let(t, lambda before: let(change(before), lambda after: F.when(F.length(normalizer_key(after)) >= LEAST_KEY, after).otherwise(before)))


def _rules(t: Column, brands: Column, variants: Column) -> Column:
    """All rules once, in order. None makes a text longer."""
    t = _replaced(_replaced(_replaced(t, HEAD_BRACKETS), HEAD_PARENTHESES), HEAD_OFFERS)
    t = _no_brand(_no_noise_before_brand(t, brands), brands)
    t = _replaced(_if_enough(t, lambda x: _replaced(x, HEAD_COUNT)), HEAD_DELIMITERS)
    for pattern, by in COUNT_PHRASES:
        t = _replaced(t, pattern, by)
    t = _stripped(t, (*PARENTHESES, BRACKETS, *PACKAGING, *SIZES))
    t = F.reduce(variants, t, lambda now, v: _if_enough(now, lambda x: _replaced(x, v)))
    return F.coalesce(clean_text(t), F.lit(""))


def display_name(name: Column, aliases: Column, variants: Column) -> Column:
    """a name without tags, offers, brand, sizes, packaging and variants; the clean name where nothing would be left.

    ``aliases`` (array of texts) are the brand's names, ``variants`` values such as the shade; null elements count for
    nothing, a null array for an empty one. The rules are applied until none changes the text. Each round that changes
    it makes it shorter, so rounds are bounded by the text's length; rounds after the last change only pass it on.
    A null or blank name is null.
    """
    none = F.array().cast("array<string>")

    def made(text: Column, brands: Column, ends: Column) -> Column:
        def once(state: Column, _: Column) -> Column:
            changed = let(_rules(state["text"], brands, ends), lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done")))
            return F.when(state["done"], state).otherwise(changed)

        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        fixed = F.reduce(F.sequence(F.lit(1), F.length(text) + 1), start, once)["text"]
        bare = let(fixed, lambda f: F.coalesce(clean_text(_replaced(_replaced(f, UNWRAPPED[0], " $1 "), UNWRAPPED[1], " $1 ")), f))
        return F.coalesce(clean_text(_stripped(bare, (*FLATTENED, *SIZES))), text)

    brands, ends = brand_patterns(F.coalesce(aliases, none)), variant_patterns(F.coalesce(variants, none))
    whole = F.struct(clean_text(name).alias("text"), brands.alias("brands"), ends.alias("ends"))
    return let(whole, lambda w: F.when(w["text"].isNotNull(), made(w["text"], w["brands"], w["ends"])))


def brand_names(texts: Sequence[Column], registered: Column) -> Column:
    """The names by which a record's brand may stand in its product name: Hangul ones without their blanks (if that leaves
    a key of four characters), the texts, and the registered names; each spelling once, in either case."""
    given = F.transform(F.array(*texts), clean_text)

    def joined(t: Column) -> Column:
        compact = F.replace(t, F.lit(" "), F.lit(""))
        return F.when(has_hangul(t) & (compact != t) & (F.length(normalizer_key(compact)) >= LEAST_KEY), compact)

    every = F.concat(F.transform(given, joined), given, F.transform(F.coalesce(registered, F.array().cast("array<string>")), clean_text))
    listed = F.filter(every, lambda t: t.isNotNull())
    once = F.transform(listed, lambda t, i: F.when(F.array_position(F.transform(listed, casefold), casefold(t)) == i + 1, t))
    return F.filter(once, lambda t: t.isNotNull())


def translated_type(name: Column, terms: Sequence[tuple[str, str]] = TYPE_TERMS) -> Column:
    """the name with its longest product-type term in English (of equally long ones the first of the list); null
    without such a term, and where Hangul is left."""

    def in_english(t: Column) -> Column:
        longest = sorted(terms, key=lambda x: -len(x[0]))
        found = F.coalesce(*(F.when(F.contains(t, F.lit(term)), F.replace(t, F.lit(term), F.lit(english))) for term, english in longest))
        return let(clean_text(found), lambda f: F.when(~has_hangul(f), f))

    return let(clean_text(name), in_english)
