"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments, and an index holds for each segment and value the codes that have it. If segment ``i`` is
searched to radius ``r_i``, every code within ``sum(r_i + 1) - 1`` bits of the query is met in some segment: were it
further in all of them, it would differ in more bits. So the radii grow, half of the segments at a time; each round
verifies what it meets by whole Hamming distance and keeps what the bound covers, and queries end once that is k rows,
as the k-th distance is then provably covered.

Equal codes are one entry with the ``k`` smallest ids, so a code that a third of all rows share is one row, and equal
queries are searched once. A join gives pairs within the bound only, which are few, and not all that share a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import written


#: Bits of a segment at most: so many bits' values may become probes of a query.
WIDEST = 16


def sign_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, code)``: bit ``i`` of a long is set where component ``i`` is positive; at most 64 components.

    A null component counts as not positive, missing ones likewise; rows with a null vector or a null id have no code
    and are left out. Longer vectors are an error.
    """
    bits = F.transform(F.col(vector_col), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    fits = F.when(F.size(vector_col) > 64, F.raise_error(F.lit("codes have at most 64 bits")).cast("long")).otherwise(code)
    known = rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    return known.select(F.col(id_col).alias("id"), fits.alias("code"))


def _cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of each segment, the wider ones first."""
    widths = [bits // segments + (i < bits % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _piece(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")


def _masks(width: int, radius: int) -> Column:
    """All values of so many bits with at most ``radius`` ones: a constant that Spark folds once, not for each query."""
    found = (m for m in range(1 << width) if m.bit_count() <= radius)
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<int>")


def _growth(cuts: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Radii of the rounds: all 0, then one more for the first half of the segments, then for the others, and so on."""
    half = (len(cuts) + 1) // 2
    radii = [0] * len(cuts)
    yield radii
    while any(r < w for r, (_, w) in zip(radii, cuts)):
        for part in (range(half), range(half, len(cuts))):
            radii = [min(r + (i in part), cuts[i][1]) for i, r in enumerate(radii)]
            yield radii


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int = 5) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` rows of ``base (id, code)`` nearest to each row of ``queries (id, code)``.

    Exact; ties go to the smaller id; a query that is itself in ``base`` finds itself. With fewer than ``k`` rows in
    the base all of them are returned, with none no rows. Repeated ids in ``queries`` get their result each. Any number
    of segments gives the same result; fewer and wider ones meet fewer codes and take more probes, which is shorter for
    very many codes. Segments have WIDEST bits at most.
    """
    first = Window.partitionBy("code").orderBy("id")
    entries = written(base.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k), "codes")
    by_code = entries.groupBy("code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    cuts = _cuts(bits, min(max(segments, -(-bits // WIDEST)), bits))
    pieces = F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), _piece(F.col("code"), *cut).alias("value")) for s, cut in enumerate(cuts))))
    index = written(by_code.select("code", "first_id", "n", pieces.alias("p")).select("p.*", "code", "first_id", "n"), "code-index")
    enough = entries.limit(k).count()

    active = written(queries.select(F.col("code").alias("qcode")).distinct(), "queries")
    finished: list[DataFrame] = []
    nearest = Window.partitionBy("qcode").orderBy("distance", "first_id")
    differ = F.col("qcode").bitwiseXOR(F.col("code"))
    for radii in _growth(cuts) if enough else ():
        covered = sum(radii) + len(radii) - 1

        def values(s: int, cut: tuple[int, int], r: int) -> Column:
            return F.transform(_masks(cut[1], r), lambda m: F.struct(F.lit(s).alias("seg"), F.col("own")[s].bitwiseXOR(m).alias("value")))

        # Few queries make many probes: they are dealt out before, or the task of one small file would make them all.
        spread = active.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qcode")
        asked = spread.select("qcode", F.array(*(_piece(F.col("qcode"), *cut) for cut in cuts)).alias("own"))
        probes = asked.select("qcode", F.explode(F.concat(*(values(s, cut, r) for s, (cut, r) in enumerate(zip(cuts, radii))))).alias("p")).select("qcode", "p.*")
        # A code that several segments meet is taken at the first of them.
        once = F.lit(True)
        for s, (cut, r) in enumerate(zip(cuts, radii)):
            once = once & ((F.col("seg") <= s) | (F.bit_count(_piece(differ, *cut)) > r))
        # The size of what explode makes is not known to the planner, so it must not choose to broadcast it.
        met = probes.hint("merge").join(index, ["seg", "value"]).where((F.bit_count(differ) <= covered) & once)
        near = met.select("qcode", "code", "first_id", "n", F.bit_count(differ).alias("distance")).withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= k)
        found = written(near.drop("rn"), "nearest")
        done = found.groupBy("qcode").agg(F.sum("n").alias("rows")).where(F.col("rows") >= enough).select("qcode")
        finished.append(found.join(done, "qcode", "left_semi"))
        active = written(active.join(done, "qcode", "left_anti"), "queries")
        if active.isEmpty():
            break
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("qcode"))
    out = finished[0] if finished else asked.select("qcode", F.col("qcode").alias("code"), F.lit(0).alias("distance")).where(F.lit(False))
    for more in finished[1:]:
        out = out.unionByName(more)
    ids = out.select("qcode", "code", "distance").join(entries.select("code", "id"), "code")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("qcode").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return asked.join(ranked, "qcode").select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))


#: op2 in DuckDB: every query against every row.
ORACLE_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, b.vec_id AS id,
             CAST(list_sum(list_transform(list_zip(q.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM c q, c b WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""
