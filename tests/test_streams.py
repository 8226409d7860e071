"""Streams over several files give what the batch forms give; suppression and upserts go batch by batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillmart.operators import analytics, matching, upsert
from quillmart.streaming import query_log

LOG = "seq long, ts timestamp, user_id long, query string, result_count long, elapsed_ms double, failed boolean"


def log_folder(spark, path, files=4):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=3 * i), i % 3, rng.choice(["lip tint", "립틴트", "cushion", "x", " "]), rng.randrange(12), rng.random() * 100, False) for i in range(200)]
    size = len(rows) // files
    for k in range(files):  # in order of time, as rows behind the watermark would be late
        spark.createDataFrame(rows[k * size : (k + 1) * size], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return spark.read.parquet(f"{path}/log"), query_log.log_stream(spark, f"{path}/log", spark.read.parquet(f"{path}/log").schema)


def test_gap_stream_equals_its_batch(spark, tmp_path):
    batch, stream = log_folder(spark, tmp_path)
    got = query_log.drained(query_log.running_gaps(stream), f"{tmp_path}/c1", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, analytics.fold_search_gaps(batch, ("ts", "seq")).select(got.columns).collect()))


def test_popularity_and_sessions(spark, tmp_path):
    batch, stream = log_folder(spark, tmp_path)
    got = query_log.drained(query_log.windowed_popularity(stream, "1 hour", "30 minutes"), f"{tmp_path}/c2", "complete")
    assert sum(r["uses"] for r in got.collect()) == 2 * batch.where(F.trim("query") != "").count() + 2 * batch.where(F.trim("query") == "").count()
    got = query_log.drained(query_log.sessions(stream, "8 minutes"), f"{tmp_path}/c3", "complete")
    assert sum(r["searches"] for r in got.collect()) == 200


def test_refreshes_are_suppressed_within_their_time(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, s), 1, q, 1, 1.0, False) for i, (s, q) in enumerate([(0, "Lip tint"), (10, "립틴트"), (20, "cushion"), (30, "립틴트")])]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = query_log.log_stream(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    got = query_log.drained(query_log.refresh_requests(stream), f"{tmp_path}/c4", "append")
    assert sorted(r["query_key"] for r in got.collect()) == ["립틴트", "쿠션"]


def test_upsert_stream_equals_one_fold(spark, tmp_path):
    schema = "record_key string, seq int, observed_at int, source string, category string, sale_price double"
    rows = [("k1", 1, 10, "a", "x", 1.0), ("k2", 2, 11, "a", None, None), ("k1", 3, 12, "b", None, None), ("k3", 4, 13, "c", "z", 3.0), ("k1", 5, 9, "d", "y", 5.0), ("k2", 6, 14, "e", None, 2.0)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = sorted((f.stat().st_mtime_ns, str(f)) for f in (tmp_path / "in").glob("*.parquet"))
    arrived = [spark.read.parquet(f).first()["seq"] for _, f in files]
    stream = query_log.log_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    run = query_log.upsert_stream(stream, lambda now, batch: upsert.upsert_onto(now, batch, ("seq",)), f"{tmp_path}/t", f"{tmp_path}/c5").start()
    run.awaitTermination()
    got = {r["record_key"]: r for r in spark.read.parquet(f"{tmp_path}/t/v{run.lastProgress['batchId']}").collect()}
    place = {s: i for i, s in enumerate(arrived)}
    for k in ("k1", "k2", "k3"):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: place[r[1]])
        known = [r[4] for r in mine if r[4] is not None]
        assert (got[k]["source"], got[k]["sale_price"], got[k]["category"]) == (mine[-1][3], mine[-1][5], known[-1] if known else None)
        assert (got[k]["first_seen_at"], got[k]["last_seen_at"]) == (min(r[2] for r in mine), max(r[2] for r in mine))


def test_token_classes_and_match_gates(spark):
    df = spark.createDataFrame([(1, "클리오 킬커버 쿠션 21 핑크"), (2, "쿠션"), (3, "핑크 쿠션"), (4, "브랜드"), (5, None)], "i int, q string").select("i", matching.token_classes(F.col("q")).alias("t")).select("i", "t.*")
    got = {r["i"]: r for r in df.collect()}
    assert (got[1]["category"], got[1]["distinctive"], got[1]["compact"], got[1]["strict"]) == (["쿠션"], ["클리오", "킬커버"], "클리오 킬커버 쿠션", True)
    assert (got[2]["distinctive"], got[2]["strict"]) == ([], False) and got[3]["strict"] and not got[4]["strict"] and got[5]["key"] == ""
    classes = spark.createDataFrame([("클리오", "클리오", ""), ("립", None, "립"), ("모공", None, "모공"), ("킬 커버", None, "킬 커버")], "q string, alias string, rest string")
    assert [r[0] for r in classes.select(matching.query_class(F.col("q"), F.col("alias"), F.col("rest"), F.col("q") == "립")).collect()] == ["brand", "broad", "discovery", "ordinary"]
    pairs = spark.createDataFrame([(1, "킬커버 쿠션", "클리오 킬커버 쿠션", 50, 10, 0), (1, "킬커버 쿠션", "클리오 킬커버 팩트", 90, 10, 1), (2, "쿠션", "립밤", 1, None, 0), (3, "핑크 쿠션", "립밤", 1, None, 0)], "query_id int, product_query string, name string, quality_score int, source_priority int, index int")
    ranked = matching.rank_matches(matching.match_scores(pairs, ["name"])).collect()
    assert sorted((r["query_id"], r["rank"], r["name"], r["match_score"]) for r in ranked) == [(1, 1, "클리오 킬커버 쿠션", 120), (2, 1, "립밤", 0)]
