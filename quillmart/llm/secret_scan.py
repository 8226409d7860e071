"""Secret scan: known key shapes, and random strings found by a battery of randomness tests.

DataFrame functions only. Positions are code points: what lies between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so their lengths add up to starts and ends.

Random strings: the encoding of each long run of code characters is inferred from its alphabet. Under the hypothesis
that it is random in that encoding, three tests give tail probabilities: chi-squared uniformity of its characters, the
number of runs above and below the alphabet's middle, and lag-1 serial correlation. The least of the three times three
is the string's ``p``. Benjamini-Hochberg, within each class of encoding and length, then says which strings are *not*
random at a false-discovery rate of ``fdr``: among the strings that are cleared, the expected share of random ones is
at most ``fdr``, at every length, however many short or long strings there are. What is not cleared is a span. Runs of
letters in one case (words) have no claim to an encoding and are not tested. A run that mixes the marks of two
alphabets (a path before a key) is tested by its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillmart.llm.common import written

#: The known shapes. A match of ``assign`` needs VALUE_CHARS in its second group; the other two have
#: their least lengths in the pattern, which is the same as dropping shorter matches, as their runs are maximal.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
VALUE_CHARS = 6
KINDS = ("assign", "access", "hex", "random")

#: Runs that are tested for randomness.
RUN_CHARS = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN_CHARS},}}={{0,2}}"
#: What is tested of a run whose whole alphabet is no encoding's: parts without ``+`` and ``/``, and of those that have
#: no encoding either, parts without ``-`` and ``_``.
PARTS = (rf"[A-Za-z0-9_-]{{{RUN_CHARS},}}", rf"[A-Za-z0-9]{{{RUN_CHARS},}}")
#: Matches whose positions are added up in one array.
GROUP = 256
#: Share of random strings among the cleared ones.
FDR = 0.05

#: Alphabets by inferred encoding, in the order of their code values.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """``array<struct<start, end, hit>>`` of leftmost matches that don't overlap; ``possible`` is a cheap necessary test.

    Ends add up over groups of GROUP matches, as an array is copied for each entry that it gets.
    """
    entries = "array<struct<start:int,end:int,hit:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def empty(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(entries).alias("out")).cast(f"struct<at:int,out:{entries}>")

    def grouped(all_pairs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(1), F.size(all_pairs), F.lit(GROUP)), lambda i: F.slice(all_pairs, i, F.lit(GROUP)))
        added = F.aggregate(groups, F.array(empty(F.lit(0))), lambda acc, g: F.concat(acc, F.array(F.aggregate(g, empty(F.element_at(acc, -1)["at"]), add))))
        return F.flatten(F.transform(added, lambda a: a["out"]))

    few = F.size(hits) <= GROUP
    found = F.when(few, F.aggregate(pairs, empty(F.lit(0)), add, lambda acc: acc["out"])).otherwise(_let(pairs, grouped))
    return F.when(possible, found).otherwise(F.array().cast(entries))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; an expression alone would be computed each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0 (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""

    def tail(x: Column) -> Column:
        return _let(1 / (1 + 0.3275911 * x), lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x))

    return _let(z, tail)


def _upper_tail(score: Column) -> Column:
    return _let(score, lambda z: _let(_erfc(F.abs(z) / F.lit(2.0**0.5)), lambda e: F.when(z >= 0, e / 2).otherwise(1 - e / 2)))


def _two_tails(score: Column) -> Column:
    return _erfc(F.abs(score) / F.lit(2.0**0.5))


def encoding_of(token: Column) -> Column:
    """The inferred encoding of a run, null where its alphabet makes none likely (words, numbers, paths, mixtures)."""
    digit, upper, lower = token.rlike("[0-9]"), token.rlike("[A-Z]"), token.rlike("[a-z]")
    mixed = digit & (upper | lower) | upper & lower & ~token.rlike("^[A-Z]?[a-z]+$")
    return (
        F.when(token.rlike("^[0-9a-f]+$") & digit & lower, "hex")
        .when(token.rlike("^[0-9A-F]+$") & digit & upper, "hex_upper")
        .when(token.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(token.rlike("^[A-Za-z0-9+/]+$") & mixed, "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$") & mixed & digit, "base64url")
    )


def randomness(token: Column, encoding: Column) -> Column:
    """``p`` of the battery for a run under its encoding."""
    alphabet = F.element_at(F.create_map(*(F.lit(x) for item in ALPHABETS.items() for x in item)), encoding)

    def known(k: Column) -> Column:
        """What the tests need, each computed once: characters, alphabet size, half-alphabet bits and centred code values."""
        size = F.length(k["alphabet"])
        half = F.floor(size / 2).cast("int")
        bits = F.call_function("translate", k["token"], k["alphabet"], F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), size - half)))
        values = F.transform(F.filter(F.split(k["token"], ""), lambda c: c != ""), lambda c: F.instr(k["alphabet"], c) - 1 - (size - 1) / 2)
        counts = F.transform(F.filter(F.split(k["alphabet"], ""), lambda c: c != ""), lambda c: (F.length(k["token"]) - F.length(F.replace(k["token"], c, F.lit("")))).cast("double"))
        return F.struct(F.length(k["token"]).cast("double").alias("n"), size.cast("double").alias("size"), bits.alias("bits"), values.alias("values"), counts.alias("counts"))

    def summed(k: Column) -> Column:
        add = lambda a, v: a + v
        zero = F.lit(0.0)
        pairs = F.zip_with(F.slice(k["values"], F.lit(2), F.size(k["values"])), F.slice(k["values"], F.lit(1), F.size(k["values"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            k["n"].alias("n"),
            k["size"].alias("size"),
            F.aggregate(k["counts"], zero, lambda a, c: a + c * c).alias("squares"),
            F.length(F.replace(k["bits"], F.lit("0"), F.lit(""))).cast("double").alias("ones"),
            (F.length(F.regexp_replace(k["bits"], "(?<=0)1|(?<=1)0", "xx")) - F.length(k["bits"])).cast("double").alias("changes"),
            F.aggregate(k["values"], zero, add).alias("total"),
            F.aggregate(k["values"], zero, lambda a, v: a + v * v).alias("power"),
            F.aggregate(pairs, zero, lambda a, v: a + v["a"] * v["b"]).alias("lagged"),
            F.element_at(k["values"], 1).alias("first"),
            F.element_at(k["values"], -1).alias("last"),
        )

    def tested(k: Column) -> Column:
        n, df = k["n"], k["size"] - 1
        chi2 = F.greatest(k["squares"] * k["size"] / n - n, F.lit(0.0))
        uniform = _upper_tail((F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        # All on one side has no run test; uniformity speaks there.
        one_sided = (k["ones"] == 0) | (k["ones"] == n)
        mean = 2 * k["ones"] * (n - k["ones"]) / n + 1
        runs = _let(mean, lambda m: F.when(one_sided, F.lit(1.0)).otherwise(_two_tails((k["changes"] + 1 - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(1e-9))))))
        average = k["total"] / n
        power = k["power"] - k["total"] * average
        covered = k["lagged"] - average * (2 * k["total"] - k["first"] - k["last"]) + (n - 1) * average * average
        serial = _let(power, lambda w: F.when(w <= 0, F.lit(0.0)).otherwise(_two_tails((covered / w + 1 / n) * F.sqrt(n))))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    start = F.struct(token.alias("token"), alphabet.alias("alphabet"))
    return _let(start, lambda k: _let(known(k), lambda k: _let(summed(k), tested)))


def length_class(token: Column) -> Column:
    """Classes grow by factors of about 1.4: tests on longer strings tell more."""
    return F.floor(2 * F.log2(F.length(token).cast("double"))).cast("int")


def clearing_levels(candidates: DataFrame, fdr: float = FDR) -> DataFrame:
    """``(encoding, length_class, level)``: in its class, a string with ``p`` at or below ``level`` is cleared.

    Benjamini-Hochberg on a grid of 400 steps of p (a factor of 10 ** 0.05 each), so what is gathered are counts by
    class and step, not strings. A class in which nothing is cleared has level 0.
    """
    step = F.least(F.lit(400), F.greatest(F.lit(0), F.floor(-20 * F.log10(F.greatest(F.col("p"), F.lit(1e-30)))))).cast("int")
    counts = candidates.groupBy("encoding", "length_class", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("encoding", "length_class")
    least = F.pow(F.lit(10.0), -F.col("step") / 20)  # the largest p that falls into the step
    below = F.sum("n").over(by_class.orderBy(F.desc("step")))
    ranked = counts.select("encoding", "length_class", least.alias("p"), below.alias("below"), F.sum("n").over(by_class).alias("m"))
    cleared = F.max(F.when(F.col("p") <= fdr * F.col("below") / F.col("m"), F.col("p")))
    return ranked.groupBy("encoding", "length_class").agg(F.coalesce(cleared, F.lit(0.0)).alias("level"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``(id, spans array<struct<start, end, kind>>)`` of every document, base kinds and random strings, by start, then kind.

    A random string inside a base span is not told again. A null text counts as empty; rows stay as they are in number.
    Texts are read once: what is kept for the second step are spans and probabilities.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | low.contains(word)
    none = "array<struct<start:int,end:int,kind:int>>"

    def base(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(none)

    assign = F.filter(_matches(text, ASSIGN, named), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= VALUE_CHARS)
    kinds = [base(assign, 0), base(_matches(text, ACCESS, text.contains("AKIA")), 1), base(_matches(text, HEX, text.rlike(HEX)), 2)]
    runs = _matches(text, RUN, text.rlike(RUN))
    found = docs.select(F.col(id_col).alias("id"), F.concat(*kinds).alias("base"), runs.alias("runs"))

    def bare(m: Column, at: Column) -> Column:
        hit = F.rtrim(m["hit"], F.lit("="))
        return F.struct((at + m["start"]).alias("start"), (at + m["end"]).alias("end"), hit.alias("hit"), encoding_of(hit).alias("encoding"))

    def in_parts(strings: Column, pattern: str) -> Column:
        parts = lambda m: F.transform(_matches(m["hit"], pattern, m["hit"].rlike(pattern)), lambda x: bare(x, m["start"]))
        return F.flatten(F.transform(strings, lambda m: F.when(m["encoding"].isNotNull(), F.array(m)).otherwise(parts(m))))

    strings = F.transform("runs", lambda m: bare(m, F.lit(0)))
    for pattern in PARTS:
        strings = in_parts(strings, pattern)
    tested = F.filter(strings, lambda m: m["encoding"].isNotNull())
    scored = F.transform(
        tested,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["encoding"].alias("encoding"),
            length_class(m["hit"]).alias("length_class"),
            randomness(m["hit"], m["encoding"]).alias("p"),
        ),
    )
    found = written(found.select("id", "base", scored.alias("runs")), "secrets")
    levels = clearing_levels(found.select(F.explode("runs").alias("r")).select("r.*"), fdr)
    # A row for each encoding and length class: some dozens, whatever the corpus.
    entries = [F.lit(x) for r in levels.collect() for x in (f"{r['encoding']}:{r['length_class']}", float(r["level"]))]
    by_class = F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(0.0))

    def suspected(r: Column) -> Column:
        level = F.try_element_at(by_class, F.concat_ws(":", r["encoding"], r["length_class"].cast("string")))
        return (r["p"] > F.coalesce(level, F.lit(0.0))) & ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]))

    random = F.transform(F.filter("runs", suspected), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(3).alias("kind"))).cast(none)
    spans = F.array_sort(F.transform(F.concat("base", random), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    named_spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind")))
    return found.select(F.col("id").alias(id_col), named_spans.alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, ``base_sha256`` and all ``spans`` as text, from the spans of :func:`scan`."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))
