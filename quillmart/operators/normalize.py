"""From a source record to a product: brand resolution, prices, offer, score; detail enrichment; re-normalization diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.names import brand_names, display_name, translated_type
from quillmart.functions.text import absolute_url, brand_key, clean_text, has_hangul, has_latin, let
from quillmart.operators.containment import join_inside
from quillmart.operators.merge import missing_fields, quality_score
from quillmart.shared import once_for_each, spread

#: Words that shops write in place of a brand.
BRAND_NOISE = ("(NEW", "NEW", "뿌리는")
#: Columns that the re-normalization job compares.
NORMALIZED_COLUMNS = ("source_brand_name", "source_brand_name_en", "product_name_en", "product_name_display_ko", "product_name_display_en", "source_url", "image_url", "currency")
#: Aliases up to which containment is tested against one constant array in each row.
ALIAS_LITERALS = 1000


def alias_table(registry: DataFrame) -> DataFrame:
    """``(alias_key, alias, official_en, position)`` of ``registry (official_en, alias, position)``: each key once, the first entry.

    An alias with 앤 is also entered with 엔; Hangul aliases of a brand come first, then the order of the file.
    """
    spelled = F.array_distinct(F.array("alias", F.replace("alias", F.lit("앤"), F.lit("엔"))))
    rows = registry.select("official_en", "position", F.posexplode(F.transform(spelled, lambda a: clean_text(a))).alias("variant", "alias"))
    rows = rows.where(F.col("alias").isNotNull()).withColumn("alias_key", brand_key(F.col("alias"))).where(F.col("alias_key") != "")
    at = F.struct(F.when(has_hangul(F.col("alias")), 0).otherwise(1), "position", "variant")
    once = rows.groupBy("alias_key").agg(F.min_by(F.struct("alias", "official_en", "position"), at).alias("r"))
    return once.select("alias_key", "r.*")


def _literals(aliases: DataFrame) -> Column | None:
    """All aliases as one constant array, the longest first; None where there are more than ALIAS_LITERALS."""
    few = aliases.select("alias_key", "alias", "official_en", "position").limit(ALIAS_LITERALS + 1).collect()
    if len(few) > ALIAS_LITERALS:
        return None
    few.sort(key=lambda r: (-len(r["alias_key"]), r["position"], r["alias_key"]))
    rows = [F.struct(*(F.lit(r[c]).alias(n) for c, n in (("alias_key", "key"), ("official_en", "official_en"), ("alias", "alias")))) for r in few]
    return F.array(*rows) if rows else F.array().cast("array<struct<key:string,official_en:string,alias:string>>")


def _spoken(text: Column) -> Column:
    """Keys of a text's words and of the whole text, for aliases of which some syllables are written as initials."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ]+"), F.lit(0))
    keys = F.transform(F.concat(words, F.array(F.coalesce(text, F.lit("")))), lambda w: brand_key(w))
    return F.array_distinct(F.filter(keys, lambda w: (F.length(w) >= 2) & w.rlike(f"[{INITIALS}]")))


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _spells(word: Column, alias_key: Column) -> Column:
    """Whether each character of a word is the alias's, or its initial."""
    agree = F.zip_with(_letters(word), _letters(alias_key), lambda a, b: (a == b) | (F.contains(F.lit(INITIALS), a) & (a == hangul_initials(b))))
    return (F.length(word) == F.length(alias_key)) & F.forall(agree, lambda x: x)


def match_brand(df: DataFrame, aliases: DataFrame, text_cols: Sequence[str], out: str = "brand_match") -> DataFrame:
    """``out``, a struct ``(official_en, alias)``: for the first text that has any, the longest alias inside it (by
    keys, then the registry's order), else the longest Hangul alias that a word of it spells with initials (F24).

    The alias table is a dimension. Up to ALIAS_LITERALS aliases, whose number is counted first, become one constant
    array that each row is tested against; beyond that, aliases are found by equi-joins on the key's substrings of the
    lengths that aliases have, and on the initials of words.
    """
    table = _literals(aliases)
    if table is None:
        return _by_substrings(df, aliases, text_cols, out)
    hangul = F.filter(table, lambda a: has_hangul(a["alias"]) & (F.length(a["key"]) >= 2))
    found = F.lit(None).cast("struct<official_en:string,alias:string>")
    for c in reversed(text_cols):
        inside = let(brand_key(F.col(c)), lambda k: F.try_element_at(F.filter(table, lambda a: F.contains(k, a["key"])), F.lit(1)))
        spelled = let(_spoken(F.col(c)), lambda ws: F.try_element_at(F.filter(hangul, lambda a: F.exists(ws, lambda w: _spells(w, a["key"]))), F.lit(1)))
        hit = F.coalesce(inside, F.when(F.col(c).rlike(f"[{INITIALS}]"), spelled))
        found = F.coalesce(let(hit, lambda h: F.when(h.isNotNull(), F.struct(h["official_en"].alias("official_en"), h["alias"].alias("alias")))), found)
    return df.withColumn(out, found)


def _by_substrings(df: DataFrame, aliases: DataFrame, text_cols: Sequence[str], out: str) -> DataFrame:
    """:func:`match_brand` for alias tables of any size."""
    rows = df.withColumn("__row", F.xxhash64(*(F.col(c) for c in text_cols)))
    texts = F.array(*(F.struct(brand_key(F.col(c)).alias("k"), F.col(c).alias("t")) for c in text_cols))
    pool = rows.select("__row", F.posexplode(texts).alias("no", "x")).select("__row", "no", F.col("x.k").alias("k"), F.col("x.t").alias("t")).distinct()
    table = aliases.select("alias_key", F.struct("official_en", "alias").alias("named"), "position")
    inside = join_inside(pool, "k", table, "alias_key").withColumn("loose", F.lit(0))
    words = pool.where(F.col("t").rlike(f"[{INITIALS}]")).withColumn("word", F.explode(_spoken(F.col("t")))).withColumn("initials", hangul_initials(F.col("word")))
    hangul = aliases.where(has_hangul(F.col("alias")) & (F.length("alias_key") >= 2)).select("alias_key", F.struct("official_en", "alias").alias("named"), "position", hangul_initials(F.col("alias_key")).alias("initials"))
    spelled = words.join(hangul, "initials").where(_spells(F.col("word"), F.col("alias_key"))).withColumn("loose", F.lit(1))
    columns = ("__row", "no", "loose", "alias_key", "position", "named")
    met = inside.select(*columns).unionByName(spelled.select(*columns))
    best = met.groupBy("__row").agg(F.min_by("named", F.struct("no", "loose", -F.length("alias_key"), "position", "alias_key")).alias(out))
    return rows.join(best, "__row", "left").drop("__row")


def resolve_brand(df: DataFrame, aliases: DataFrame, brand_col: str, text_cols: Sequence[str] = (), out: str = "brand_en", external: DataFrame | None = None, keep_match: str | None = None) -> DataFrame:
    """The official brand: by the key of the brand, else by :func:`match_brand` in the texts, else by ``external``,
    else the brand itself where it is Latin without Hangul, else null.

    ``external`` (X1) is a second alias table, asked in the same way, for brands that are missing, Hangul or not Latin;
    an official name without Latin letters counts as none. ``keep_match`` names a column for what :func:`match_brand` found.
    """
    brand = F.col(brand_col)
    latin = F.coalesce(has_latin(brand) & ~has_hangul(brand), F.lit(False))

    def asked(df: DataFrame, table: DataFrame, name: str) -> tuple[DataFrame, Column]:
        exact = table.select(F.col("alias_key").alias("__bk"), F.col("official_en").alias(f"__exact{name}"))
        keyed = df.withColumn("__bk", brand_key(brand)).join(exact, "__bk", "left").drop("__bk")
        if not text_cols:
            return keyed, F.col(f"__exact{name}")
        return match_brand(keyed, table, text_cols, f"__match{name}"), F.coalesce(f"__exact{name}", F.col(f"__match{name}.official_en"))

    named, found = asked(df, aliases, "1")
    if keep_match:
        named = named.withColumn(keep_match, F.col("__match1"))
    if external is not None:
        named, other = asked(named, external, "2")
        found = F.coalesce(found, F.when(~latin & has_latin(other), clean_text(other)))
    return named.withColumn(out, F.coalesce(found, F.when(latin, clean_text(brand)))).drop("__exact1", "__match1", "__exact2", "__match2")


def registered_names(aliases: DataFrame) -> DataFrame:
    """``(alias_key, names)``: for every alias, all names of its brand, Hangul ones first, then in the registry's order."""
    at = F.struct(F.when(has_hangul(F.col("alias")), 0).otherwise(1).alias("script"), "position", "alias")
    names = aliases.groupBy("official_en").agg(F.transform(F.sort_array(F.collect_list(at)), lambda a: a["alias"]).alias("names"))
    return aliases.select("alias_key", "official_en").join(names, "official_en").select("alias_key", "names")


def normalize_records(df: DataFrame, aliases: DataFrame, base_url: str, external: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Products of records. Original price: original, else regular, where 0 counts as missing; display
    price: the sale price where there is one, 0 too. Every record with a URL has one offer.

    Display names are the source's own where it gives any, else the cleaned names; an English display name that is still
    missing is the Korean one with its type translated, if no Hangul is left. Columns ``options``, ``search_keywords`` and
    ``discount_rate`` are carried over where the frame has them, and the columns that ``keep`` names as they are.
    """
    c = F.col

    def texts(given: DataFrame) -> DataFrame:
        named = resolve_brand(given, aliases, "source_brand_name", ["product_name_ko"], "__resolved", external, keep_match="__found")
        named = named.withColumns({
            "__ko": brand_ko(c("source_brand_name"), c("__found.alias"), BRAND_NOISE),
            "__en": F.coalesce(clean_text(c("source_brand_name_en")), c("__resolved")),
        }).withColumn("__key", brand_key(c("__en")))
        named = named.join(registered_names(aliases).select(c("alias_key").alias("__key"), c("names").alias("__names")), "__key", "left")
        name_ko = clean_text(c("product_name_ko"))
        name_en = F.coalesce(clean_text(c("product_name_en")), F.when(has_latin(name_ko) & ~has_hangul(name_ko), name_ko))
        brands = brand_names([c("__ko"), c("__en"), c("source_brand_name"), c("source_brand_name_en")], c("__names"))
        named = named.withColumns({"__brands": brands, "__variants": F.array("shade"), "__name_ko": name_ko, "__name_en": name_en})
        named = named.withColumn("__display_ko", F.coalesce(clean_text(c("product_name_display_ko")), display_name(c("__name_ko"), c("__brands"), c("__variants"))))
        display_en = F.coalesce(clean_text(c("product_name_display_en")), display_name(c("__name_en"), c("__brands"), c("__variants")), translated_type(c("__display_ko")))
        return named.withColumn("__display_en", display_en)

    made_of = ("source_brand_name", "source_brand_name_en", "product_name_ko", "product_name_en", "product_name_display_ko", "product_name_display_en", "shade")
    told = ("__ko", "__en", "__name_ko", "__name_en", "__display_ko", "__display_en")
    named = once_for_each(spread(df), {n: c(n) for n in made_of}, {n: c(n) for n in told}, texts)
    original = F.coalesce(F.nullif(c("original_price"), F.lit(0.0)), c("regular_price"))
    price = F.coalesce(c("sale_price"), original)
    lists = [_cleaned(c(n)).alias(n) for n in ("options", "search_keywords") if n in df.columns]
    made = named.select(
        *keep,
        clean_text(c("canonical_product_id")).alias("canonical_product_id"),
        c("__ko").alias("brand_ko"),
        c("__en").alias("brand_en"),
        c("__name_ko").alias("product_name_ko"),
        c("__name_en").alias("product_name_en"),
        c("__display_ko").alias("product_name_display_ko"),
        c("__display_en").alias("product_name_display_en"),
        clean_text(c("category")).alias("category"),
        price.alias("price"),
        original.alias("original_price"),
        c("sale_price"),
        *(c(n) for n in ("discount_rate",) if n in df.columns),
        c("rating"),
        c("review_count"),
        F.coalesce(clean_text(c("currency")), F.lit("KRW")).alias("currency"),
        clean_text(c("shade")).alias("shade"),
        absolute_url(c("image_url"), base_url).alias("image_url"),
        clean_text(c("description")).alias("description"),
        *lists,
        c("sold_out"),
        absolute_url(c("source_url"), base_url).alias("source_url"),
        clean_text(c("source_product_id")).alias("source_product_id"),
        c("source"),
        c("updated_at"),
    )
    fields = {n: c(n) for n in ("brand_ko", "brand_en", "product_name_ko", "product_name_en", "price", "image_url", "rating", "review_count", "source", "source_url", "source_product_id")}
    offer = F.struct("source", "source_product_id", "source_url", "price", "original_price", "sale_price", "currency", "image_url", "sold_out", "updated_at")
    return made.withColumns({
        "quality_score": quality_score(fields),
        "enrichment_missing_fields": missing_fields(fields),
        "offers": F.when(c("source_url").isNotNull(), F.array(offer)).otherwise(F.array().cast(F_OFFERS)),
    })


def _cleaned(texts: Column) -> Column:
    """The clean texts of a list; null where none is left."""
    return let(F.filter(F.transform(texts, clean_text), lambda t: t.isNotNull()), lambda a: F.when(F.size(a) > 0, a))


F_OFFERS = "array<struct<source:string,source_product_id:string,source_url:string,price:double,original_price:double,sale_price:double,currency:string,image_url:string,sold_out:boolean,updated_at:string>>"

#: Fields that the detail page decides if it has them.
DETAIL_FIRST = ("source_brand_name", "product_name_ko", "regular_price", "original_price", "currency", "shade", "image_url", "category", "rating", "review_count", "description", "options", "sold_out", "source_product_id", "updated_at")


def enrich_with_details(records: DataFrame, details: DataFrame, on: str = "source_url") -> DataFrame:
    """Records with what their detail page knows; sale price and discount are the page's if it has any price at all.

    ``details`` has one row for each ``on`` and the same columns. Empty texts count as missing.
    """
    fields = [f for f in (*DETAIL_FIRST, "sale_price", "discount_rate") if f in details.columns and f in records.columns and f != on]
    side = details.select(F.col(on), F.struct(*fields).alias("__d"))
    joined = records.join(side, on, "left")
    priced = F.lit(False)
    for f in ("regular_price", "original_price", "sale_price"):
        if f in fields:
            priced = priced | F.col(f"__d.{f}").isNotNull()
    out = {}
    for f in fields:
        detail = F.col(f"__d.{f}")
        if f in ("sale_price", "discount_rate"):
            out[f] = F.when(priced, detail).otherwise(F.col(f))
        elif records.schema[f].dataType.simpleString() == "string":
            out[f] = F.coalesce(F.nullif(detail, F.lit("")), F.col(f))
        else:
            out[f] = F.coalesce(detail, F.col(f))
    return joined.withColumns(out).drop("__d")


def renormalize_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str] = NORMALIZED_COLUMNS) -> DataFrame:
    """``(key, field, before, after)`` of every field that normalization would change; a null after is no change."""
    names = [c for c in columns if c in before.columns and c in after.columns]
    joined = before.select(key, F.struct(*names).alias("b")).join(after.select(key, F.struct(*names).alias("a")), key)
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"b.{n}").cast("string").alias("before"), F.col(f"a.{n}").cast("string").alias("after")) for n in names))
    rows = joined.select(key, F.explode(pairs).alias("c")).select(key, "c.*")
    return rows.where(F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))


def renormalize_backfill(
    records: DataFrame, aliases: DataFrame, base_url: str, key: str, recompute_display_names: bool = False, source_prefixes: Sequence[str] = (), samples: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(updated, changes, summary, sampled)`` of normalizing stored records again.

    ``changes`` are :func:`renormalize_diff`'s, ``summary`` counts them: ``(measure, n)`` for records scanned and changed and
    for each field. ``updated`` are all records: a changed one has all NORMALIZED_COLUMNS as normalized, nulls too, and its
    ``search_text``, if there is such a column, made anew; others stay as they are. ``sampled`` are the first changed
    records by key, with their changes as an array. Records whose source begins with none of ``source_prefixes`` (if there
    are any) are not scanned. A record is compared in its own row, so nothing is joined but brands.
    """
    from quillmart.operators.index import search_text

    within = F.lit(not source_prefixes)
    for prefix in source_prefixes:
        within = within | F.startswith("source", F.lit(prefix))
    packed = records.withColumns({"__of": F.col(key), "__scanned": F.coalesce(within, F.lit(False)), "__before": F.struct(*records.columns)})
    if recompute_display_names:
        packed = packed.withColumns({c: F.lit(None).cast("string") for c in ("product_name_display_ko", "product_name_display_en")})
    after = product_to_record(normalize_records(packed, aliases, base_url, keep=("__of", "__scanned", "__before")))
    names = [c for c in NORMALIZED_COLUMNS if c in records.columns]
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"__before.{n}").cast("string").alias("before"), F.col(n).cast("string").alias("after")) for n in names))
    changed = F.filter(pairs, lambda p: p["after"].isNotNull() & ~p["before"].eqNullSafe(p["after"]))
    judged = after.withColumn("__changes", F.when(F.col("__scanned"), changed).otherwise(F.filter(pairs, lambda p: F.lit(False))))
    is_changed = F.size("__changes") > 0
    values = {n: F.col(n) for n in names} | ({"search_text": search_text(after)} if "search_text" in records.columns else {})
    updated = judged.select(*(F.when(is_changed, values[c]).otherwise(F.col(f"__before.{c}")).alias(c) if c in values else F.col(f"__before.{c}").alias(c) for c in records.columns))
    rows = judged.select(F.col("__of").alias(key), F.explode("__changes").alias("c")).select(key, "c.*")
    of = lambda n: F.coalesce(F.sum(F.when(F.exists("__changes", lambda p: p["field"] == n), 1)), F.lit(0))
    counts = {"scanned": F.count_if(F.col("__scanned")), "changed": F.count_if(is_changed)} | {f"field:{n}": of(n) for n in names}
    one = judged.agg(*(c.cast("long").alias(n) for n, c in counts.items()))
    summary = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").alias("n")) for n in counts))).alias("m")).select("m.*").where((F.col("n") > 0) | ~F.startswith("measure", F.lit("field:")))
    sampled = judged.where(is_changed).select(F.col("__of").alias(key), F.col("__changes").alias("changes")).orderBy(key).limit(samples)
    return updated, rows, summary, sampled


def product_to_record(products: DataFrame) -> DataFrame:
    """Products as source records for another ingest."""
    return products.withColumns({"regular_price": F.col("price")}).withColumnsRenamed({"brand_ko": "source_brand_name", "brand_en": "source_brand_name_en"})


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") == 1).drop("__rn")


#: Fixed value: the nineteen initial consonants of Hangul syllables, in code order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"


def hangul_initials(c: Column) -> Column:
    """A text with each Hangul syllable replaced by its initial consonant; 588 syllables share one."""
    syllables = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    initial = lambda x: F.substring(F.lit(INITIALS), F.floor((F.ascii(x) - 0xAC00) / 588).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(syllables, lambda x: F.when(x.rlike("[가-힣]"), initial(x)).otherwise(x)), "")


def initials_match(df: DataFrame, aliases: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``(key, official_en, alias)`` of texts with a word that spells a Hangul alias with some syllables as initials.

    Word and alias have the same length, and each character is equal or the alias's initial. Both sides meet in an
    equi-join on their initials; the characters verify. Of several aliases the longest, then the first in the registry.
    """
    spoken = df.select(F.col(key_col).alias("key"), F.explode(_spoken(F.col(text_col))).alias("word")).withColumn("initials", hangul_initials(F.col("word")))
    named = aliases.where(has_hangul(F.col("alias")) & (F.length("alias_key") >= 2)).select("alias_key", "alias", "official_en", "position", hangul_initials(F.col("alias_key")).alias("initials"))
    met = spoken.join(named, "initials").where(_spells(F.col("word"), F.col("alias_key")))
    best = F.struct(-F.length("alias_key"), "position", "alias_key")
    return met.groupBy("key").agg(F.min_by(F.struct("official_en", "alias"), best).alias("r")).select("key", "r.*")


def brand_ko(source_brand: Column, matched_alias: Column, noise: Sequence[str] = ()) -> Column:
    """The Korean brand: the source's, unless it is noise or the alias found in the name spells it better, else that alias.

    An alias spells it better if the keys are equal and the texts are not, or the alias's key holds the source's key.
    Noise are the given words, and brands with brackets or a leading asterisk.
    """
    text, alias = clean_text(source_brand), F.when(has_hangul(matched_alias), matched_alias)
    odd = F.lower(text).isin(*(n.lower() for n in noise)) if noise else F.lit(False)
    odd = odd | text.rlike(r"[\[\]【】]") | text.startswith("*")
    a, b = brand_key(text), brand_key(alias)
    better = (a != "") & (b != "") & F.when(a == b, text != clean_text(alias)).otherwise(F.contains(b, a))
    return F.when(has_hangul(text) & ~odd, F.when(F.coalesce(better, F.lit(False)), alias).otherwise(text)).otherwise(alias)
