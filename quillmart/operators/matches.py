"""The ledger of offer-to-product matches: candidates, reviews in order, backfills, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.keys import match_id

STATES = ("verified", "pending_review", "rejected", "invalid")


def merge_candidates(matches: DataFrame, candidates: DataFrame, offers: DataFrame, order: Sequence[str]) -> DataFrame:
    """M1: the ledger after automatic candidates. New ones are pending; a pending match takes the latest candidate's
    confidence, method and evidence; a reviewed one keeps its own. Candidates of unknown offers are left out.

    ``matches`` has ``match_id, canonical_product_id, offer_id, confidence, match_method, review_state, reviewed_by``;
    ``candidates`` the four middle ones and ``order``; ``offers`` ``offer_id, source, source_product_id``. ``evidence``
    goes with confidence and method where both have it.
    """
    known = candidates.join(offers.select("offer_id", "source", "source_product_id"), "offer_id")
    named = known.withColumn("match_id", match_id(F.col("canonical_product_id"), F.col("source"), F.col("source_product_id")))
    judged = ["confidence", "match_method"] + ["evidence"] * ("evidence" in matches.columns and "evidence" in candidates.columns)
    fields = ("canonical_product_id", "offer_id", *judged)
    latest = named.groupBy("match_id").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("c"))
    both = matches.join(latest, "match_id", "full")
    open_ = F.col("review_state").isNull() | (F.col("review_state") == "pending_review")
    fresh = F.col("review_state").isNull()
    return both.select(
        "match_id",
        F.when(fresh, F.col("c.canonical_product_id")).otherwise(F.col("canonical_product_id")).alias("canonical_product_id"),
        F.when(fresh, F.col("c.offer_id")).otherwise(F.col("offer_id")).alias("offer_id"),
        *(F.when(open_ & F.col("c").isNotNull(), F.col(f"c.{n}")).otherwise(F.col(n)).alias(n) for n in judged),
        F.coalesce("review_state", F.lit("pending_review")).alias("review_state"),
        "reviewed_by",
    )


def backfill_verified(matches: DataFrame, offers: DataFrame, actor: str) -> DataFrame:
    """M2: the ledger and a verified match for every offer that has none. Existing matches stay as they are."""
    made = offers.select(
        match_id(F.col("canonical_product_id"), F.col("source"), F.col("source_product_id")).alias("match_id"),
        "canonical_product_id", "offer_id", F.lit(1.0).alias("confidence"), F.lit("verified_catalog").alias("match_method"), F.lit("verified").alias("review_state"), F.lit(actor).alias("reviewed_by"),
    ).dropDuplicates(["match_id"])
    return matches.select(made.columns).unionByName(made.join(matches, "match_id", "left_anti"))


def judge_confirmed(matches: DataFrame, offers: DataFrame, mappings: DataFrame, order: Sequence[str]) -> DataFrame:
    """M3: every confirmed mapping with its ``match_id`` and ``outcome``, before anything is written.

    ``incomplete`` without canonical id, product id or URL; ``conflict`` where its (source, product id) belongs to another
    product: by an offer, or, where there is no offer yet, by the first complete mapping in ``order``; else ``linked``.
    ``needs_offer`` and ``needs_match`` say whether its offer or match does not exist yet. ``offers`` has
    ``canonical_product_id, source, source_product_id``, ``matches`` ``match_id``. All that belongs to a pair is
    aggregated by pair, so no order of rows counts.
    """
    pair = ["source", "source_product_id"]
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    complete = given("canonical_product_id") & given("source_product_id") & given("source_url")
    claims = mappings.where(complete).groupBy(*pair).agg(F.min_by("canonical_product_id", F.struct(*order)).alias("__claim"))
    owners = offers.groupBy(*pair).agg(F.collect_set("canonical_product_id").alias("__owners"))
    known = matches.select("match_id", F.lit(True).alias("__known"))
    judged = mappings.withColumn("match_id", F.when(complete, match_id(F.col("canonical_product_id"), F.col("source"), F.col("source_product_id"))))
    judged = judged.join(claims.join(owners, pair, "left"), pair, "left").join(known, "match_id", "left")
    owned = F.when(F.col("__owners").isNotNull(), F.array_contains("__owners", F.col("canonical_product_id"))).otherwise(F.col("canonical_product_id") == F.col("__claim"))
    linked = complete & F.coalesce(owned, F.lit(False))
    outcome = F.when(~complete, "incomplete").when(linked, "linked").otherwise("conflict")
    columns = {"outcome": outcome, "needs_offer": linked & F.col("__owners").isNull(), "needs_match": linked & F.col("__known").isNull()}
    return judged.select(*mappings.columns, "match_id", *(c.alias(n) for n, c in columns.items()))


def backfill_confirmed(matches: DataFrame, offers: DataFrame, mappings: DataFrame, actor: str, order: Sequence[str], confirmed_at: str = "created_at") -> tuple[DataFrame, DataFrame, DataFrame]:
    """M3: ``(offers, matches, judged)`` after :func:`judge_confirmed`: offers that linked mappings need, and a verified match
    for each that has none, both as the first mapping in ``order`` says. What exists stays as it is, so a second run
    changes nothing. Counts of ``judged`` by outcome are those of a dry run.
    """
    judged = judge_confirmed(matches, offers, mappings, order)
    rank = F.struct(*order)
    triple = ["canonical_product_id", "source", "source_product_id"]
    extra = [c for c in offers.columns if c in mappings.columns and c not in triple and c != "offer_id"]
    kept = F.struct(F.lit(1).alias("__one"), *extra)
    made = judged.where("needs_offer").groupBy(*triple).agg(F.min_by(kept, rank).alias("__m")).select(F.concat_ws(":", *triple).alias("offer_id"), *triple, *(F.col(f"__m.{c}").alias(c) for c in extra))
    all_offers = offers.unionByName(made, allowMissingColumns=True)
    first = judged.where("needs_match").groupBy("match_id").agg(F.min_by(F.struct(*triple, F.col(confirmed_at).alias("at")), rank).alias("m")).select("match_id", "m.*")
    evidence = F.array(F.struct(F.lit("editor_confirmed_mapping").alias("type"), F.col("canonical_product_id").alias("value")))
    named = {
        "canonical_product_id": F.col("canonical_product_id"), "offer_id": F.col("offer_id"), "confidence": F.lit(1.0), "match_method": F.lit("editor_confirmed"), "evidence": evidence,
        "review_state": F.lit("verified"), "reviewed_by": F.lit(actor), "reviewed_at": F.col("at"),
    }
    linked = first.join(all_offers.groupBy(*triple).agg(F.min("offer_id").alias("offer_id")), triple)
    new = linked.select("match_id", *(c.alias(n) for n, c in named.items() if n in matches.columns))
    return all_offers, matches.unionByName(new, allowMissingColumns=True), judged


def force_reviews(matches: DataFrame, decisions: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """M4, the forced form: ``(matches, judged)``. A decision sets its state, whatever the match's state is, and leaves no
    audit event; the last one in ``order`` holds. Its outcome is ``invalid_state``, ``no_reviewer``, ``not_found`` or ``updated``.

    ``decisions`` has ``match_id, decision, reviewer, decided_at``; ``reviewed_by``, and where the ledger has them
    ``reviewed_at`` and ``updated_at``, follow the decision.
    """
    known = matches.select("match_id", F.lit(True).alias("__known"))
    outcome = (
        F.when(~F.coalesce(F.col("decision").isin(*STATES), F.lit(False)), "invalid_state")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no_reviewer")
        .when(F.col("__known").isNull(), "not_found")
        .otherwise("updated")
    )
    judged = decisions.join(known, "match_id", "left").withColumn("outcome", outcome).drop("__known")
    last = judged.where(F.col("outcome") == "updated").groupBy("match_id").agg(F.max_by(F.struct("decision", "reviewer", "decided_at"), F.struct(*order)).alias("__d"))
    values = {"review_state": "decision", "reviewed_by": "reviewer", "reviewed_at": "decided_at", "updated_at": "decided_at"}
    joined = matches.join(last, "match_id", "left")
    changed = {c: F.when(F.col("__d").isNotNull(), F.col(f"__d.{v}")).otherwise(F.col(c)) for c, v in values.items() if c in matches.columns}
    return joined.withColumns(changed).select(*matches.columns), judged


def apply_reviews(matches: DataFrame, decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    """M4 without expected versions: each decision with its outcome and the state before it.

    In order, a decision that equals the state is a ``noop``, another one is ``updated``, one on an unknown match
    ``not_found``. A state is what the last decision said, so the one before is a lag, and no history is folded in one
    array however long it is. The rows with outcome ``updated`` are the audit events.
    """
    by_match = Window.partitionBy("match_id").orderBy(*order)
    known = matches.select("match_id", F.col("review_state").alias("__state"), F.lit(True).alias("__known"))
    joined = decisions.join(known, "match_id", "left")
    before = F.coalesce(F.lag("decision").over(by_match), F.col("__state"))
    judged = joined.withColumn("previous_state", F.when(F.col("__known"), before))
    outcome = F.when(F.col("__known").isNull(), "not_found").when(F.col("previous_state") == F.col("decision"), "noop").otherwise("updated")
    return judged.withColumn("outcome", outcome).drop("__state", "__known")


def apply_versioned_reviews(matches: DataFrame, decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    """M4 with optimistic concurrency: a decision whose ``expected_version`` isn't the match's version is a ``conflict``.

    A match's version is the ``decided_at`` of its last update (its ``updated_at`` at first). Whether one decision
    takes effect depends on all before it, so the decisions of one match are folded in order in one array.
    """
    row = F.struct(*order, *(c for c in ("decision", "decided_at", "expected_version") if c not in order))
    logs = decisions.groupBy("match_id").agg(F.sort_array(F.collect_list(row)).alias("log"))
    known = matches.select("match_id", F.col("review_state").alias("state"), F.col("updated_at").alias("version"), F.lit(True).alias("known"))
    both = logs.join(known, "match_id", "left")
    out = f"array<struct<{', '.join(f'{o}:{decisions.schema[o].dataType.simpleString()}' for o in order)},decision:string,previous_state:string,outcome:string>>"

    def step(acc, x):
        stale = x["expected_version"].isNotNull() & ~x["expected_version"].eqNullSafe(acc["version"])
        outcome = F.when(stale, "conflict").when(x["decision"] == acc["state"], "noop").otherwise("updated")
        done = outcome == "updated"
        told = F.struct(*(x[o].alias(o) for o in order), x["decision"].alias("decision"), acc["state"].alias("previous_state"), outcome.alias("outcome"))
        return F.struct(F.when(done, x["decision"]).otherwise(acc["state"]).alias("state"), F.when(done, x["decided_at"]).otherwise(acc["version"]).alias("version"), F.concat(acc["out"], F.array(told)).alias("out"))

    start = F.struct("state", "version", F.array().cast(out).alias("out"))
    folded = F.aggregate("log", start, step, lambda acc: acc["out"])
    missing = F.transform("log", lambda x: F.struct(*(x[o].alias(o) for o in order), x["decision"].alias("decision"), F.lit(None).cast("string").alias("previous_state"), F.lit("not_found").alias("outcome"))).cast(out)
    return both.select("match_id", F.explode(F.when(F.col("known"), folded).otherwise(missing)).alias("r")).select("match_id", "r.*")


#: Columns of the product that stands for a canonical id.
TARGET = ("source_brand_name", "source_brand_name_en", "product_name_ko", "product_name_display_ko", "image_url")


def with_targets(rows: DataFrame, products: DataFrame, order: Sequence[str] = ("last_seen_at", "record_key")) -> DataFrame:
    """Rows with ``target``, the last product in ``order`` of their canonical id as a struct of ``TARGET``; null without one.

    Products of the rows' ids alone are aggregated, and the rows are as few as a page or a selection.
    """
    asked = rows.select("canonical_product_id").distinct()
    met = products.where(F.col("canonical_product_id").isNotNull()).join(asked, "canonical_product_id", "left_semi")
    best = met.groupBy("canonical_product_id").agg(F.max_by(F.struct(*(c for c in TARGET if c in products.columns)), F.struct(*order)).alias("target"))
    return rows.join(best, "canonical_product_id", "left")


def pending_page(matches: DataFrame, offers: DataFrame, limit: int, after: str | None = None, source: str | None = None) -> DataFrame:
    """M5: the next ``limit`` pending matches by id behind ``after``, with their offers; :func:`with_targets` adds products."""
    rows = matches.where(F.col("review_state") == "pending_review").join(offers.select("offer_id", "source", "source_product_id", "source_url"), "offer_id")
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if after is not None:
        rows = rows.where(F.col("match_id") > after)
    return rows.orderBy("match_id").limit(limit)


def with_history(matches: DataFrame, events: DataFrame, order: Sequence[str]) -> DataFrame:
    """M6: matches with their review events in order, an empty array for those without."""
    kept = [c for c in events.columns if c != "match_id"]
    log = events.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in kept if c not in order)))).alias("history"))
    joined = matches.join(log, "match_id", "left")
    return joined.withColumn("history", F.coalesce("history", F.array().cast(joined.schema["history"].dataType)))


def violations(matches: DataFrame) -> DataFrame:
    """M8: matches of an unknown state, and verified ones without reviewer."""
    unknown = ~F.coalesce(F.col("review_state").isin(*STATES), F.lit(False))
    unsigned = (F.col("review_state") == "verified") & (F.trim(F.coalesce("reviewed_by", F.lit(""))) == "")
    return matches.withColumn("violation", F.when(unknown, "state").when(unsigned, "reviewer")).where(F.col("violation").isNotNull())


def import_candidates(rows: DataFrame, known_products: DataFrame, offers: DataFrame, matches: DataFrame, strict: bool = True) -> DataFrame:
    """Each imported row with its ``outcome``.

    ``invalid`` with a ``reason`` for missing or wrong fields; ``unknown`` for a canonical id that isn't known (strict);
    ``conflict`` where the offer belongs to another product; then ``created``, ``updated`` (pending) or ``preserved``
    (reviewed). A row's earlier twins in the same file don't count: the file is a batch.
    """
    required = ("canonical_product_id", "source", "source_product_id", "source_url", "match_method", "confidence")
    reason = F.lit(None).cast("string")
    value = F.col("confidence").try_cast("double")
    reason = F.when(F.trim("confidence") == "", reason).when(value.isNull() | ~value.between(0, 1), "confidence").otherwise(reason)
    for name in reversed(required):
        reason = F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", f"missing {name}").otherwise(reason)
    judged = rows.withColumn("reason", reason).withColumn("match_id", match_id(F.col("canonical_product_id"), F.col("source"), F.col("source_product_id")))
    known = known_products.select(F.col("canonical_product_id")).distinct().withColumn("__known", F.lit(True))
    owner = offers.groupBy("source", "source_product_id").agg(F.min("canonical_product_id").alias("__owner"))
    state = matches.select("match_id", F.col("review_state").alias("__state"))
    joined = judged.join(known, "canonical_product_id", "left").join(owner, ["source", "source_product_id"], "left").join(state, "match_id", "left")
    outcome = (
        F.when(F.col("reason").isNotNull(), "invalid")
        .when(F.col("__known").isNull() & F.lit(strict), "unknown")
        .when(F.col("__owner") != F.col("canonical_product_id"), "conflict")
        .when(F.col("__state").isNull(), "created")
        .when(F.col("__state") == "pending_review", "updated")
        .otherwise("preserved")
    )
    return joined.withColumn("outcome", outcome).drop("__known", "__owner", "__state")
