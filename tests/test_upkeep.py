"""Shared likes, ordered ingest, constraints, step counters, snapshots, refreshes, streams of sessions and retention, embedding once."""

from __future__ import annotations

import json
import math
import random
import threading
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import activity, cache, collaborative, constraints, curation, embedding, ingest, progress, refresh
from lumenshelf.sources import partitions, snapshot
from lumenshelf.streaming import retention, sessions

START = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- shared likes -------------------------------------------------------------


def test_pairs_of_every_block_size(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(6), rng.randrange(40)) for _ in range(150)})
    df = spark.createDataFrame(rows, "user_id long, book_id long")
    expected = sorted((u, a, b) for u in range(6) for a in range(40) for b in range(a + 1, 40) if (u, a) in rows and (u, b) in rows)
    for block in (1, 3, 1000):
        found = collaborative.pairs_within(df, "user_id", "book_id", block).select("user_id", "x.book_id", "y.book_id")
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_similarity_and_scores(spark):
    rng = random.Random(2)
    likes = sorted({(rng.randrange(30), rng.randrange(25)) for _ in range(300)})
    by = defaultdict(set)
    for u, b in likes:
        by[b].add(u)
    similar = {}
    for a in by:
        for b in by:
            n = len(by[a] & by[b])
            if a < b and n >= 3:
                similar[a, b] = n / math.sqrt(len(by[a]) * len(by[b])) * n / (n + 10)
    df = spark.createDataFrame(likes + likes[:9] + [(None, 3), (4, None)], "user_id long, book_id long")
    found = collaborative.item_similarity(df)
    assert {(r.a, r.b): pytest.approx(r.similarity) for r in found.collect()} == similar
    mine = defaultdict(set)
    for u, b in likes:
        mine[u].add(b)
    expected = {}
    for u, books in mine.items():
        for c in set(range(25)) - books:
            s = sum(similar.get((min(b, c), max(b, c)), 0) for b in books)
            if s:
                expected[u, c] = s / len(books)
    scores = collaborative.cf_scores(df, found, df)
    assert {(r.user_id, r.book_id): pytest.approx(r.score) for r in scores.collect()} == expected


def test_one_heavy_user_spreads_over_tasks(spark):
    """A user of 10,000 books among small ones: no task makes more than 3 % of the pairs."""
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("book_id")).unionByName(spark.range(3000).select((F.col("id") % 300 + 2).alias("user_id"), F.col("id").alias("book_id")))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in collaborative.pairs_within(df, "user_id", "book_id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 10_000 * 9_999 // 2 + 300 * 45
    assert max(sizes) <= 0.03 * sum(sizes)


def test_blend(spark):
    kind = "user_id long, book_id long, score double"
    content = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (1, 12, 3.0), (2, 10, 5.0)], kind)
    cf = spark.createDataFrame([(1, 12, 0.5), (1, 13, 0.1), (3, 1, 9.0)], kind)

    def scores(stage):
        return {(r.user_id, r.book_id): round(r.score, 5) for r in collaborative.blend(content, cf, stage).collect()}

    assert scores(0) == {(1, 10): 1.0, (1, 11): 0.0, (1, 12): 0.5, (1, 13): 0.0, (2, 10): 0.0, (3, 1): 0.0}
    assert scores(1)[1, 12] == 0.7 and scores(2)[1, 12] == 0.7 and scores(3)[1, 12] == 0.8
    assert scores(3)[1, 10] == 0.4


def test_stages_need_all_below(spark):
    state = spark.range(400).select((F.col("id") < 350).alias("is_active"))
    for pairs, stage in ((199, 0), (200, 1), (1000, 2), (5000, 2)):
        similar = spark.range(pairs).select(F.lit(3).alias("shared"))
        assert tuple(collaborative.stage_of(state, similar).first()) == (350, pairs, stage)


# --- ingest in order ----------------------------------------------------------


def judged(new, books):
    """The loop: an index of editions by work that NEW rows join and updates raise."""
    index = defaultdict(list)
    for i, isbn, title, author, count in sorted(books):
        index[title, author].append([isbn or "", i, count or 0, None])
    out = []
    for pos, isbn, title, author, count in sorted(new):
        known = index[title, author]
        n = count or 0
        if not known or isbn and any(e[0] == isbn for e in known):
            known.append([isbn or "", None, n, isbn or None])
            out.append((pos, "NEW", None, None))
            continue
        best = max(known, key=lambda e: e[2])
        if n > best[2]:
            best[2] = n
            out.append((pos, "UPDATE_LOAN_COUNT", best[1], best[3]))
        else:
            out.append((pos, "SKIP", None, None))
    return out


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 1), (3, 1 << 16), (4, 50)])
def test_actions_in_order(spark, seed, width):
    rng = random.Random(seed)
    works = [(f"work{i}", f"writer{i % 3}") for i in range(12)]
    isbns = [None, "", *(f"97{i}" for i in range(9))]
    books = [(i, rng.choice(isbns), *rng.choice(works[:7]), rng.choice([None, 0, 3, 5, 9])) for i in range(20)]
    new = [(pos, rng.choice(isbns), *rng.choice(works), rng.choice([None, *range(14)])) for pos in range(1, 220)]
    rng.shuffle(new)
    found = ingest.actions_in_order(
        spark.createDataFrame(new, "pos long, isbn string, title string, author string, loan_count long").repartition(5), spark.createDataFrame(books, "book_id long, isbn string, title string, author string, loan_count long"), width=width
    )
    assert sorted(tuple(r) for r in found.select("pos", "action", "target_id", "target_isbn").collect()) == judged(new, books)


def test_actions_of_blank_and_no_rows(spark):
    kind = "pos long, isbn string, title string, author string, loan_count long"
    books = spark.createDataFrame([], "book_id long, isbn string, title string, author string, loan_count long")
    assert ingest.actions_in_order(spark.createDataFrame([], kind), books).count() == 0
    new = spark.createDataFrame([(1, None, None, None, None), (2, "1", None, None, 4), (3, "1", "", "", 5), (4, None, "", None, 5)], kind)
    found = ingest.actions_in_order(new, books).orderBy("pos").select("action", "target_id", "target_isbn").collect()
    assert [tuple(r) for r in found] == [("NEW", None, None), ("UPDATE_LOAN_COUNT", None, None), ("UPDATE_LOAN_COUNT", None, None), ("SKIP", None, None)]


# --- constraints --------------------------------------------------------------


def test_violations(spark):
    rows = [(1, 1, "good", "finished"), (1, 1, None, "reading"), (2, 9, "fine", "wishlist"), (3, None, None, None), (3, None, None, None), (4, 2, "bad", "gone")]
    shelf = spark.createDataFrame(rows, "user_id long, book_id long, rating string, status string")
    books = spark.createDataFrame([(1,), (2,), (None,)], "book_id long")
    found = rows_of(constraints.violations(shelf, constraints.SHELF, ("user_id", "book_id"), {"books": books}))
    assert found == sorted([
        ("shelf_status", "user_id=4, book_id=2", "status=gone", 1), ("shelf_rating", "user_id=2, book_id=9", "rating=fine", 1), ("wishlist_no_rating", "user_id=2, book_id=9", "status=wishlist, rating=fine", 1),
        ("shelf_user_book", "user_id=1, book_id=1", "repeated", 2), ("shelf_book", "book_id=9", "not in books", 1),
    ], key=repr)


def test_violations_of_null_columns_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "rich"), (2, "rich")], "book_id long, source_tier string")
    assert rows_of(constraints.violations(rows, constraints.VECTORS, ("book_id",))) == sorted([
        ("vector_required", "book_id=1", "book_id=1, source_tier=null", 2), ("vector_required", "book_id=null", "book_id=null, source_tier=rich", 1), ("vector_book", "book_id=1", "repeated", 2),
    ], key=repr)
    assert constraints.violations(rows, [], ("book_id",)).count() == 0
    assert constraints.violations(rows.limit(0), constraints.VECTORS, ("book_id",)).count() == 0


def test_row_rules_are_one_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("book_id"), F.lit("rich").alias("source_tier")).write.parquet(str(tmp_path / "t"))
    plan = constraints.violations(spark.read.parquet(str(tmp_path / "t")), constraints.VECTORS[:2], ("book_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


# --- steps --------------------------------------------------------------------


@pytest.mark.parametrize("written,expected,exact,failed", [(0, 5, True, True), (0, 5, False, True), (0, 0, True, False), (0, None, True, False), (89, 100, True, True), (89, 100, False, False), (90, 100, True, False)])
def test_verdicts(written, expected, exact, failed):
    assert (progress.verdict(written, expected, exact) is not None) == failed


def test_counters_come_from_the_pass_that_writes(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = spark.range(1000).repartition(4).mapInArrow(touch, "id long")
    counts = progress.counted_write(rows, lambda df: df.write.parquet(str(tmp_path / "out")), {"even": F.col("id") % 2 == 0, "never": F.col("id") < 0})
    assert counts == {"written": 1000, "even": 500, "never": 0} and runs.value == 1000
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_a_run_stops_at_a_required_step(spark, tmp_path):
    def step(name, n, **how):
        return progress.Step(name, lambda: spark.range(n), lambda df: df.write.parquet(str(tmp_path / name)), **how)

    def broken(df):
        raise OSError("disk full")

    reports = progress.run_steps([
        step("a", 10, expected=10), step("b", 5, expected=100, exact=False), step("c", 5, expected=100, required=False), progress.Step("d", lambda: spark.range(3), broken, required=False), step("e", 0, expected=4), step("f", 1),
    ])
    assert [(r.name, r.ok) for r in reports] == [("a", True), ("b", True), ("c", False), ("d", False), ("e", False)]
    assert "disk full" in reports[3].failure and reports[4].failure.startswith("no progress")


# --- snapshots ----------------------------------------------------------------


def test_snapshot_versions(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, root)
    items = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, None)], "id long, name string, v array<double>")
    first = snapshot.publish(spark, {"items": items, "none": items.limit(0)}, root, 0, "t1")
    assert (first.version, first.tables["items"].rows, first.tables["none"].rows) == (1, 2, 0)
    snapshot.publish(spark, {"items": items.where("id = 1")}, root, 1, "t2")
    manifest, tables = snapshot.load(spark, root, at_least=2)
    assert manifest.built_at == "t2" and tables["items"].count() == 1
    assert snapshot.load(spark, root, version=1)[1]["items"].count() == 2
    with pytest.raises(snapshot.SnapshotError, match="older"):
        snapshot.load(spark, root, version=1, at_least=2)
    with pytest.raises(snapshot.StaleWrite):
        snapshot.publish(spark, {"items": items}, root, 1, "t3")
    assert snapshot.versions(spark, root) == [1, 2]


def test_torn_snapshots_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    made = snapshot.publish(spark, {"t": spark.range(100).repartition(4)}, root, 0, "t")
    folder = tmp_path / "s" / made.tables["t"].path.split("/s/", 1)[1]
    whole = {p: p.read_bytes() for p in folder.glob("part-*")}
    next(iter(whole)).unlink()
    with pytest.raises(snapshot.SnapshotError, match="torn"):
        snapshot.load(spark, root)
    assert snapshot.load(spark, root, verify=False)[1]["t"].count() < 100
    for p in folder.glob("*"):
        p.unlink()
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, root)
    where = tmp_path / "s" / "manifests" / "v1.json"
    text = json.loads(where.read_text())
    (tmp_path / "s" / "manifests" / ".v1.json.crc").unlink(missing_ok=True)
    where.write_text(json.dumps(text | {"format": 99}))
    with pytest.raises(snapshot.SnapshotError, match="format"):
        snapshot.load(spark, root)
    where.write_text("{")
    with pytest.raises(snapshot.SnapshotError, match="unreadable"):
        snapshot.load(spark, root)


def test_of_two_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    snapshot.publish(spark, {"t": spark.range(1)}, root, 0, "t")
    won, lost, ready = [], [], threading.Barrier(2)

    def write(k):
        # Both have seen version 1 as the last before either commits.
        snapshot._require_last(spark, root, 1)
        ready.wait()
        try:
            won.append((k, snapshot.publish(spark, {"t": spark.range(k)}, root, 1, "t").version))
        except snapshot.StaleWrite:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in (5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == len(lost) == 1
    assert snapshot.load(spark, root)[1]["t"].count() == won[0][0]
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2


def test_cache_guard(spark):
    kind = "user_id long, hash string, result string, computing boolean, started_at timestamp"
    cached = spark.createDataFrame([(1, "a", "r1", True, START), (2, "b", "r2", True, START), (3, "c", "r3", False, None), (4, "d", None, True, START)], kind)
    computed = spark.createDataFrame([(1, "x", "new1"), (2, "y", "new2"), (5, "z", "new5"), (6, "w", "new6")], "user_id long, hash string, result string")
    live = spark.createDataFrame([(1, "x"), (2, "moved"), (3, "c"), (4, "d"), (5, "z")], "user_id long, hash string")
    after = cache.save_if_current(cached, computed, live)
    assert rows_of(after.drop("started_at")) == [(1, "x", "new1", False), (2, "b", "r2", False), (3, "c", "r3", False), (4, "d", None, True), (5, "z", "new5", False)]
    for seconds, users in ((100, {2}), (200, {2, 4})):
        assert {r.user_id for r in cache.may_start(after, live, F.lit(START + timedelta(seconds=seconds))).collect()} == users


# --- refresh ------------------------------------------------------------------

SHELF = "user_id long, book_id long, rating string, status string, updated_at timestamp"


def shelf_of(spark, rows):
    return spark.createDataFrame([(u, b, *v) for (u, b), v in rows.items()], SHELF)


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 2)])
def test_refresh_equals_recomputing(spark, seed, block):
    rng = random.Random(seed)

    def value():
        return rng.choice(["good", "good", "bad", None]), rng.choice(["finished", "wishlist", "reading"]), START + timedelta(days=rng.randrange(90))

    now: dict = {}
    counters = spark.createDataFrame([], "user_id long, total_likes long, total_saves long, total_finished long, n_rows long, last_active_at timestamp")
    pairs = spark.createDataFrame([], "a long, b long, co_like long, co_save long")
    as_of = F.lit(START + timedelta(days=90))
    for _ in range(4):
        before = dict(now)
        for key in rng.sample(sorted(now), len(now) // 3):
            if rng.random() < 0.5:
                del now[key]
            else:
                now[key] = value()
        for _ in range(60):
            now[rng.randrange(9), rng.randrange(15)] = value()
        if before:
            gone = rng.choice(sorted({u for u, _ in now}))
            now = {k: v for k, v in now.items() if k[0] != gone}
        old, new = shelf_of(spark, before) if before else shelf_of(spark, now).limit(0), shelf_of(spark, now)
        changes = refresh.changes_between(old, new)
        assert rows_of(refresh.shelf_after(old, changes)) == rows_of(new)
        counters = spark.createDataFrame(refresh.refresh_counters(counters, changes, new).collect(), counters.schema)
        pairs = spark.createDataFrame(refresh.refresh_pairs(pairs, old, changes, block).collect(), pairs.schema)
        expected = activity.user_state(new, as_of)
        assert rows_of(refresh.state_of(counters, as_of).select(expected.columns)) == rows_of(expected)
        for least in (1, 2):
            assert rows_of(refresh.frequent_pairs(pairs, least)) == rows_of(activity.co_occurrence(new, least))


# --- sessions and retention ---------------------------------------------------


def session_rows(events, minutes=30):
    by = defaultdict(list)
    for u, t, k in events:
        by[u].append((t, k))
    out = []
    for u, rows in by.items():
        rows.sort()
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] - rows[i - 1][0] > timedelta(minutes=minutes):
                part = rows[start:i]
                out.append((u, part[0][0], part[-1][0], len(part), sum(k in ("click", "purchase") for _, k in part)))
                start = i
    return sorted(out)


def test_sessions_at_the_gap(spark):
    events = [(1, START + timedelta(minutes=m), "view") for m in (0, 29, 58, 88, 119)] + [(2, START, "click"), (2, START, "purchase"), (None, START, "view")]
    found = sorted(tuple(r) for r in sessions.sessions(spark.createDataFrame([*events, (3, None, "view")], "user_id long, ts timestamp, event_type string")).collect())
    assert found == session_rows([e for e in events if e[0]])
    assert len(found) == 3


def streamed(spark, tmp_path, batches, kind, build, name):
    """Rows that a stream over the batches gives, and the query's progress."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder / f"{i:03}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()], query.recentProgress


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.randrange(5), START + timedelta(minutes=rng.randrange(60 * 24)), rng.choice(["view", "click"])) for _ in range(200)]
    events.sort(key=lambda e: e[1])
    batches = [events[i : i + 40] for i in range(0, 200, 40)] + [[(99, START + timedelta(days=9), "view")], [(99, START + timedelta(days=9, minutes=1), "view")]]
    found, _ = streamed(spark, tmp_path, batches, "user_id long, ts timestamp, event_type string", sessions.stream_sessions, "sessions_out")
    assert sorted(r for r in found if r[0] != 99) == session_rows(events)


def test_retention_on_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.randrange(4), rng.randrange(5), START + timedelta(hours=rng.randrange(24 * 80))) for _ in range(150)), key=lambda r: r[2])
    end = rows[-1][2]
    batches = [rows[i : i + 15] for i in range(0, 150, 15)]
    # Two rows of another pair let the watermark pass the last ones.
    tail = [[(9, 9, end + timedelta(hours=1))], [(9, 9, end + timedelta(hours=1, minutes=1))]]
    found, _ = streamed(spark, tmp_path / "a", batches + tail, "user_id long, theme_id long, shown_at timestamp", retention.recently_shown, "shown_out")
    watermark = end + timedelta(minutes=1)
    # A pair's rows come out in order: the last tells what is held.
    last = {}
    for u, t, at, n, expired in found:
        last[u, t] = (at, n, expired)
    held = {k for k, (_, _, expired) in last.items() if not expired and k != (9, 9)}
    table = spark.createDataFrame(rows, "user_id long, theme_id long, shown_at timestamp")
    batch = {(r.user_id, r.theme_id): r.shown_at for r in curation.retained(table, "shown_at", F.lit(watermark)).groupBy("user_id", "theme_id").agg(F.max("shown_at").alias("shown_at")).collect()}
    assert held == set(batch) and all(last[k][0] == batch[k] for k in held)
    assert any(expired for *_, expired in found)


def test_state_empties_after_the_days(spark, tmp_path):
    rows = [(u, t, START + timedelta(hours=u)) for u in range(5) for t in range(4)]
    later = START + timedelta(days=60)
    found, steps = streamed(spark, tmp_path / "b", [rows, [(9, 9, later)], [(9, 9, later + timedelta(minutes=1))]], "user_id long, theme_id long, shown_at timestamp", retention.recently_shown, "emptied_out")
    assert {(u, t) for u, t, _, _, expired in found if expired} == {(u, t) for u, t, _ in rows}
    assert steps[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert Counter(n for *_, n, expired in found if expired) == {1: 20}


# --- embedding and partitions -------------------------------------------------


def test_texts_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    inner = embedding.hash_embedder(4)

    def embed(texts):
        calls.add(len(texts))
        assert len(texts) <= 3
        return inner(texts)

    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)] + [(90, None), (91, " ")], "id long, text string")
    path = str(tmp_path / "cache")
    first = {r.id: r.vec for r in embedding.embedded(rows, embed, path, "m", 3).collect()}
    assert calls.value == 7 and first[3] == inner(["text 3"])[0] and first[90] is None and first[91] is None
    more = rows.unionByName(spark.createDataFrame([(99, "new"), (100, "text 1")], "id long, text string"))
    again = {r.id: r.vec for r in embedding.embedded(more, embed, path, "m", 3).collect()}
    assert calls.value == 8 and again[100] == first[1] and {i: again[i] for i in first} == first
    embedding.embedded(rows, embed, path, "other", 3).count()
    assert calls.value == 15
    assert embedding.cached(spark, path).count() == 15


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(90).select("id", (F.col("id") % 3).alias("part"))
    partitions.refresh_partitions(rows, path, ["part"])
    before = {p: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / f"part={p}").glob("*.parquet")} for p in range(3)}
    partitions.refresh_partitions(rows.where("part = 1 and id < 20"), path, ["part"])
    after = {p: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / f"part={p}").glob("*.parquet")} for p in range(3)}
    assert after[0] == before[0] and after[2] == before[2] and not set(after[1]) & set(before[1])
    assert spark.read.parquet(path).groupBy("part").count().orderBy("part").collect() == [(0, 30), (1, 7), (2, 30)]


# --- users and items on a grid ------------------------------------------------


def grid_world(spark, n_items=40, n_users=6, dims=4, seed=8):
    import numpy as np

    from lumenshelf.operators import scoring

    rng = np.random.default_rng(seed)
    items = spark.createDataFrame([(b, rng.normal(size=dims).tolist(), ["rich", "minimal", "kakao_desc"][b % 3]) for b in range(n_items)], "book_id long, desc array<double>, source_tier string")
    reasons = spark.createDataFrame([(b, b * 10 + j, f"r{b}{j}", rng.normal(size=dims).tolist(), j) for b in range(n_items) if b % 5 for j in range(b % 3 + 1)], "book_id long, reason_pos long, reason string, vec array<double>, user_mention_count int")
    agg = scoring.aggregate_reasons(items, reasons)
    vectors = items.select("book_id", F.col("desc").alias("vec"))
    shelf = spark.createDataFrame([(u, (u * 7 + k * 11) % n_items, "good" if k % 2 else "bad", "finished") for u in range(n_users) for k in range(5)], "user_id long, book_id long, rating string, status string")
    feedback = shelf.where("book_id % 3 = 0").join(vectors, "book_id").select("user_id", "book_id", "rating", "vec")
    signals = spark.createDataFrame([(u, (u * 7 + 3) % n_items) for u in range(n_users)], "user_id long, book_id long").withColumn("signal", F.lit("not_interested"))
    users = scoring.profiles(shelf, feedback, signals, vectors, agg)
    return items, reasons, agg, vectors, shelf, feedback, signals, users


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_exact_best_is_stage_two_of_everything(spark, block_bytes):
    from lumenshelf.operators import scoring
    from lumenshelf.operators.blocks import top_per

    items, reasons, _, vectors, shelf, feedback, signals, users = grid_world(spark)
    taken = shelf.select("user_id", "book_id").unionByName(signals.select("user_id", "book_id"))
    everything = users.select("user_id").crossJoin(items.select("book_id")).join(taken, ["user_id", "book_id"], "left_anti")
    for signal in (True, False):
        scored = scoring.stage_two(everything, users, shelf, feedback, items, reasons, vectors, signals=signal)
        expected = {(r.user_id, r["rank"]): (r.book_id, pytest.approx(r.score)) for r in top_per(scored, ["user_id"], [F.desc("score"), "book_id"], 7).collect()}
        found = scoring.exact_best(users, shelf, feedback, items, reasons, vectors, taken, 7, signals=signal, block_bytes=block_bytes)
        assert {(r.user_id, r["rank"]): (r.book_id, r.score) for r in found.collect()} == expected and len(expected) == 42


def test_items_do_not_pass_the_driver(spark):
    from lumenshelf.operators import similar

    items = grid_world(spark)[0]
    queries = items.select(F.col("book_id").alias("query_id"), F.col("desc").alias("vec"), F.array("book_id").alias("exclude"))
    plan = similar.similar_to_vectors(queries, items, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_all_reasons_in_blocks(spark, monkeypatch, block_bytes):
    import numpy as np

    from lumenshelf.operators import bridge, kernels

    items, reasons, _, _, shelf, _, _, _ = grid_world(spark)
    books = items.withColumn("genre", F.concat(F.lit("국내도서>g"), (F.col("book_id") % 4).cast("string"), F.when(F.col("book_id") % 9 == 0, ">유아").otherwise("")))
    markers = shelf.where("rating = 'good'").join(reasons, "book_id").select("user_id", F.col("reason_pos").alias("marker_id"), F.lit(0.5).alias("weight"), "vec")
    monkeypatch.setattr(kernels, "blocks_of", lambda rows, row_bytes, b=0: max(1, rows.count() * row_bytes // block_bytes))
    found = {(r.user_id, r["rank"]): (r.book_id, round(r.score, 9), r.reason) for r in bridge.by_all_reasons(markers, reasons, shelf, books, 5).collect()}

    def unit(v):
        return np.array(v) / np.linalg.norm(v)

    told, own, genre = defaultdict(list), defaultdict(set), {r.book_id: r.genre for r in books.collect()}
    for r in sorted(reasons.collect(), key=lambda r: r.reason_pos):
        if "유아" not in genre[r.book_id]:
            told[r.book_id].append((r.reason, unit(r.vec)))
    for r in shelf.collect():
        own[r.user_id].add(r.book_id)
    mine = defaultdict(list)
    for r in sorted(markers.collect(), key=lambda r: r.marker_id):
        mine[r.user_id].append(unit(r.vec))
    expected = {}
    for u, ms in mine.items():
        parts = {p for b in own[u] for p in genre[b].split(">")} - {"국내도서"}
        rows = []
        for b, rs in told.items():
            if b not in own[u]:
                best = [max((float(m @ v), -k) for k, (_, v) in enumerate(rs)) for m in ms]
                boost = min(0.1 * len(parts & set(genre[b].split(">"))), 0.3)
                rows.append((-round(sum(s for s, _ in best) / len(ms) * (1 + boost), 9), b, rs[-max(best)[1]][0]))
        for k, (s, b, reason) in enumerate(sorted(rows)[:5]):
            expected[u, k + 1] = (b, -s, reason)
    assert {k: (b, r) for k, (b, _, r) in found.items()} == {k: (b, r) for k, (b, _, r) in expected.items()}
    assert all(abs(found[k][1] - expected[k][1]) < 1e-8 for k in expected)


def test_silhouette_of_a_large_shelf():
    import numpy as np

    from lumenshelf.operators import variants

    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    x = np.eye(3, 64)[labels] * 5 + rng.normal(size=(4000, 64)) * 0.1
    assert variants.silhouette(x, labels) > 0.8


def test_theme_lists_of_fitted_clusters(spark, sf_dir):
    """Clusters of the catalogue feed themes of their kind: the nearest covered books, in order of distance."""
    from lumenshelf.operators import catalogue, variants
    from lumenshelf.sources import views

    items = views.items(spark, sf_dir)
    assigned, _ = variants.catalogue_clusters(items, "v1", k=4)
    kind = "id long, kind string, l1 string, l2 string, author string, keyword string, cluster_id int, cluster_version string, min_books int, max_books int"
    themes = spark.createDataFrame([(c, "cluster", None, None, None, None, c, "v1", 1, 6) for c in range(4)] + [(9, "cluster", None, None, None, None, 0, "v0", 1, 6)], kind)
    covered = {r.book_id for r in items.where("cover_url is not null").collect()}
    expected = defaultdict(list)
    for r in sorted(assigned.collect(), key=lambda r: (r.distance, r.book_id)):
        if r.book_id in covered and len(expected[r.cluster_id]) < 6:
            expected[r.cluster_id].append(r.book_id)
    found = {r.id: r.book_ids for r in catalogue.theme_lists(themes, items, assigned).collect()}
    assert found == {**{c: expected[c] or None for c in range(4)}, 9: None}
