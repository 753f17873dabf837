"""Re-ranking, sampling and streams, which SQL does not state."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from lumenshelf.operators import activity, catalogue, feed, ingest, scoring, taste, variants
from lumenshelf.plans import bridge_queries, taste_queries
from lumenshelf.sources import views
from lumenshelf.streaming import shelf as streams


def test_mmr_chooses_as_by_hand(spark):
    rng = np.random.default_rng(1)
    v = {b: (x / np.linalg.norm(x)).tolist() for b, x in enumerate(rng.normal(size=(30, 8)))}
    items = spark.createDataFrame(list(v.items()), "book_id long, desc array<double>")
    score = {b: float(s) for b, s in enumerate(sorted(rng.random(30) * 4, reverse=True))}
    ranked = spark.createDataFrame([(u, b + 1, b, score[b]) for u in (1, 2) for b in range(30)], "user_id long, rank int, book_id long, score double")
    chosen: list[int] = []
    while len(chosen) < 8:
        rest = [b for b in v if b not in chosen]
        chosen.append(max(rest, key=lambda b: 0.6 * score[b] - (0.4 * 5 * max(np.dot(v[b], v[c]) for c in chosen) if chosen else 0)))
    got = taste.mmr_rerank(ranked, items, 8).orderBy("user_id", "rank").collect()
    assert [r.book_id for r in got] == chosen * 2


def test_sample_repeats_and_follows_weights(spark, sf_dir):
    rows = spark.createDataFrame([(i, 100.0 if i < 5 else 0.01) for i in range(200)], "book_id long, w double")
    a, b, c = ({r.book_id for r in catalogue.weighted_sample(rows.repartition(n), F.col("w"), F.lit(seed), "book_id", 5).collect()} for n, seed in ((1, "x"), (7, "x"), (3, "y")))
    assert a == b and len(a & set(range(5))) >= 4 and len(c & set(range(5))) >= 4


def test_themes_without_a_match_are_inactive(spark, sf_dir):
    got = {r.id: r for r in taste_queries.cu1_theme_lists(spark, sf_dir).collect()}
    assert len(got) == 7 and not got[4].active and got[4].book_ids is None


def test_stream_totals_equal_the_batch(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/events"
    views.table(spark, sf_dir, "events").repartition(4).write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.run_available(streams.user_totals(source), f"{tmp_path}/c1", "totals").awaitTermination(120)
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, streams.user_totals(spark.read.parquet(path)).collect()))


def test_stream_click_rate_equals_the_batch(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/events"
    views.table(spark, sf_dir, "events").repartition(1).write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    streams.run_available(streams.hourly_click_rate(source), f"{tmp_path}/c2", "rates").awaitTermination(120)
    batch = spark.read.parquet(path).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("h"))
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_keeps_user_state(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/events"
    views.table(spark, sf_dir, "events").select("user_id", "event_id").repartition(3).write.parquet(path)
    source = spark.readStream.schema("user_id long, event_id long").option("maxFilesPerTrigger", 1).parquet(path)
    now, out = F.lit("2024-02-01").cast("timestamp"), f"{tmp_path}/state"
    shelf = views.shelf(spark, sf_dir)
    streams.keep_state(source, lambda: shelf, now, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{tmp_path}/c3").awaitTermination(300)
    got = {tuple(r) for r in spark.read.parquet(out).drop("batch").distinct().collect()}
    assert got == {tuple(r) for r in activity.user_state(shelf.where("user_id >= 0"), now).collect()}


def test_stream_transitions_equal_the_batch(spark, tmp_path):
    kind = "user_id long, book_id long, state string, at timestamp, event_id long"
    rows = spark.range(120).selectExpr("id % 3 as user_id", "id % 2 as book_id", "case id * 7 % 5 when 0 then 'good' when 1 then 'bad' end as state", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as at", "id as event_id")
    for n in range(3):
        rows.where(f"event_id div 40 = {n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run_available(streams.changes_of(source), f"{tmp_path}/c4", "changes", "append").awaitTermination(300)
    assert sorted(map(tuple, spark.table("changes").collect())) == sorted(map(tuple, activity.transitions(rows).collect()))


def test_feed_repeats_nothing(spark, sf_dir):
    rows = bridge_queries.fd2_feed(spark, sf_dir).collect()
    tier = {r.user_id: r.tier for r in activity.user_state(views.shelf(spark, sf_dir), F.lit("2024-02-01").cast("timestamp")).collect()}
    covered = {r.book_id for r in views.items(spark, sf_dir).where("coalesce(cover_url, '') <> ''").collect()}
    books, slots = {}, {}
    for r in rows:
        slots.setdefault((r.user_id, r.slot), []).append(r)
        if r.book_id is not None:
            assert r.book_id in covered and (r.user_id, r.book_id) not in books
            books[r.user_id, r.book_id] = r
    kinds = {t: [k for k, _ in s] for t, s in feed.TEMPLATES.items()}
    for (user, slot), own in slots.items():
        want = kinds[tier[user]][slot]
        assert len(own) <= 10 and {r.type for r in own} <= {want} | ({"curation"} if want == "similar" else set())
        assert want == "category_nav" or sorted(r.rank for r in own) == list(range(1, len(own) + 1))
    themes = [(u, c) for (u, _), own in slots.items() for c in {r.curation_id for r in own} - {None}]
    assert len(themes) == len(set(themes)) and {u for u, _ in slots} == set(tier)


def test_taste_clusters_tell_two_tastes(spark):
    rng = np.random.default_rng(2)
    a, b = np.r_[np.ones(6), np.zeros(6)], np.r_[np.zeros(6), np.ones(6)]
    rows = [(1, k, (x + rng.normal(size=12) * 0.05).tolist(), 1.0 + (k % 2)) for k, x in enumerate([a] * 7 + [b] * 5)]
    rows += [(2, k, a.tolist(), 1.0) for k in range(4)] + [(2, 9, b.tolist(), 0.0)]
    got = variants.taste_clusters(spark.createDataFrame(rows, "user_id long, book_id long, vec array<double>, weight double")).collect()
    one = sorted((r.books, r.method) for r in got if r.user_id == 1)
    assert one == [(5, "kmeans"), (7, "kmeans")] and sum(r.weight for r in got if r.user_id == 1) == 1.0
    assert [(r.method, r.books, r.vec) for r in got if r.user_id == 2] == [("weighted_avg", 4, a.tolist())]


def test_silhouette_by_hand():
    x, labels = np.array([[0.0], [1.0], [10.0], [11.0], [50.0]]), np.array([0, 0, 1, 1, 2])
    want = []
    for i in range(5):
        own = [abs(x[i, 0] - x[j, 0]) for j in range(5) if j != i and labels[j] == labels[i]]
        other = min(np.mean([abs(x[i, 0] - x[j, 0]) for j in range(5) if labels[j] == c]) for c in set(labels) - {labels[i]})
        want.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0)
    assert abs(variants.silhouette(x, labels) - np.mean(want)) < 1e-12


def test_recall_of_a_list(spark):
    exact = spark.createDataFrame([(1, k, k) for k in range(1, 5)] + [(2, 1, 7)], "user_id long, rank int, book_id long")
    found = spark.createDataFrame([(1, 1, 2), (1, 2, 99), (1, 3, 4)], "user_id long, rank int, book_id long")
    assert {r.user_id: r.recall for r in variants.recall(found, exact, 4).collect()} == {1: 0.5, 2: 0.0}


def test_stage_one_is_the_same_in_blocks(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(b, rng.normal(size=4).tolist(), "rich") for b in range(60)], "book_id long, desc array<double>, source_tier string")
    agg = items.select("book_id", F.reverse("desc").alias("agg"))
    vectors = items.select("book_id", F.col("desc").alias("vec"))
    shelf = spark.createDataFrame([(u, (u * 7 + k * 11) % 60, "good" if k % 2 else "bad", "finished") for u in range(5) for k in range(6)], "user_id long, book_id long, rating string, status string")
    none = spark.createDataFrame([], "user_id long, book_id long, rating string, vec array<double>")
    users = scoring.profiles(shelf, none, none.select("user_id", "book_id"), vectors, agg)
    one, many = ({(r.user_id, r["rank"]): (r.book_id, round(r.score, 9)) for r in scoring.stage_one(users, items, agg, shelf, 9, block_bytes=n).collect()} for n in (1 << 20, 640))
    assert one == many and len(one) == 45


USAGE = [
    (1, json.dumps({"response": {"book": {"loanCnt": "40"}, "loanHistory": [{"loan": {"loanCnt": "3"}}, {"loan": {"loanCnt": "x"}}, {"loan": {"loanCnt": "4"}}], "keywords": [{"keyword": {"word": "바다", "weight": "2.5"}}, {"keyword": {"word": ""}}, {"keyword": {"word": "긴 말", "weight": "1"}}, {"keyword": {"word": "바다", "weight": "bad"}}], "coLoanBooks": [{"book": {"isbn13": str(k)}} for k in range(60)]}}, ensure_ascii=False)),
    (2, json.dumps({"response": {"book": {"loanCnt": "0"}}})), (3, None),
]


def test_usage_of_a_response(spark):
    got = {r.id: r for r in ingest.usage(spark.createDataFrame(USAGE, "id long, body string"), "body").collect()}
    assert (got[1].loan_count, got[1].loan_count_12mo, got[1].library_keywords, got[1].is_empty) == (40, 7, ["바다", "긴 말", "바다"], False)
    assert got[1].co_loan_isbns == [str(k) for k in range(50)] and got[2].is_empty and got[3].is_empty and got[3].loan_count == 0


def test_a_page_of_equal_isbn_wins(spark):
    wanted = spark.createDataFrame([(1, "9788937460050", "동물농장", "조지 오웰"), (2, "9788937460051", "1984", "조지 오웰"), (3, "9788937460052", "x", "y")], "book_id long, isbn string, title string, author string")
    pages = [(1, 0, 10, "1", "동물 농장", "조지 오웰 (지은이)"), (1, 1, 11, "9788937460050", "z", "z"), (2, 0, 20, "1", "1984", "한강"), (2, 1, 21, "1", "1984 (양장)", "조지 오웰 지음"), (2, 2, 22, "1", "1984", "조지 오웰"), (3, 0, 30, None, None, None)]
    found = ingest.match_pages(spark.createDataFrame(pages, "book_id long, pos int, page_id long, isbn string, title string, author string"), wanted)
    assert sorted(map(tuple, found.collect())) == [(1, 11, "isbn"), (2, 21, "title_fallback")]
