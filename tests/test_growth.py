"""What larger tables cost: rows that name books instead of carrying them, and the same results however the work is cut."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import scoring


def catalogue(spark, n=60, outside=5, dims=4):
    """Items, their reasons and vectors, and a shelf of which some books are outside the index."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(b, rng.normal(size=dims).tolist()) for b in range(n + outside)], "book_id long, vec array<double>")
    items = vectors.where(F.col("book_id") < n).select("book_id", F.col("vec").alias("desc"), F.lit("rich").alias("source_tier"))
    reasons = spark.createDataFrame([(b, b * 10 + j, rng.normal(size=dims).tolist()) for b in range(n) if b % 5 for j in range(b % 3 + 1)], "book_id long, reason_pos long, vec array<double>")
    shelf = spark.createDataFrame([(u, (u * 7 + k * 11) % (n + outside), ("good", "bad", None)[k % 3], "wishlist" if k % 3 == 2 else "finished") for u in range(8) for k in range(12)], "user_id long, book_id long, rating string, status string")
    feedback = shelf.where("book_id % 3 = 0").join(vectors, "book_id").select("user_id", "book_id", "rating", F.reverse("vec").alias("vec"))
    signals = spark.createDataFrame([(u, (u * 7 + 3) % n) for u in range(8)], "user_id long, book_id long")
    agg = scoring.aggregate_reasons(items, reasons)
    return items, reasons, vectors, shelf, feedback, agg, scoring.profiles(shelf, feedback, signals, vectors, agg)


def test_a_profile_carries_no_vector_of_the_index(spark):
    """A user's row grew by a vector for each book, and twice that for each liked one."""
    users = catalogue(spark)[-1]
    vectors = {f.name for f in users.schema.fields if f.dataType.simpleString() == "array<array<double>>"}
    assert vectors == {"own_vec", "fb_vec"}
    for u in users.collect():
        assert all(b >= 60 for b in u.own_ids) and len(u.own_ids) == len(u.own_vec) and len(u.fb_ids) == len(u.fb_vec)
        assert {b for name in scoring.ROLES for b in u[name] if b >= 60} == set(u.own_ids)
    assert users.where(F.size("own_ids") > 0).count() > 0


@pytest.mark.parametrize("part", [("single",), ("single", "per_book")])
def test_named_books_come_in_turns(spark, part):
    """What users name exceeds the bound many times; the result is that of one block."""
    items, _, _, shelf, _, agg, users = catalogue(spark)
    one, many = ({(r.user_id, r["rank"]): (r.book_id, round(r.score, 9)) for r in scoring.stage_one(users, items, agg, shelf, 9, parts=part, block_bytes=n).collect()} for n in (1 << 20, 300))
    assert one == many and len(one) == 72


@pytest.mark.parametrize("mode", list(scoring.MODES))
def test_precise_parts_in_turns(spark, mode):
    items, reasons, vectors, shelf, feedback, _, users = catalogue(spark)
    asked = users.select("user_id").crossJoin(items.select("book_id"))
    one, many = ({(r.user_id, r.book_id): [round(x, 9) for x in r[2:]] for r in scoring.components(asked, users, shelf, feedback, items, reasons, vectors, mode, n).collect()} for n in (1 << 20, 300))
    assert one == many and len(one) == 480


def test_precise_parts_by_hand(spark):
    """The reason part of one pair against a plain sum, with feedback and a liked book outside the index."""
    items, reasons, vectors, shelf, feedback, _, users = catalogue(spark)
    told, vec = {}, {r.book_id: np.array(r.vec) for r in vectors.collect()}
    for r in sorted(reasons.collect(), key=lambda r: r.reason_pos):
        told.setdefault(r.book_id, []).append(np.array(r.vec))
    said = {(r.user_id, r.book_id): np.array(r.vec) for r in feedback.where("rating is not null").collect()}
    rows = [r for r in shelf.collect() if r.rating]
    got = {(r.user_id, r.book_id): r for r in scoring.components(users.select("user_id").crossJoin(items.select("book_id")), users, shelf, feedback, items, reasons, vectors).collect()}
    for (u, b), r in got.items():
        parts = []
        for s in rows:
            if s.user_id == u:
                mine = told.get(s.book_id, [])
                ms = np.mean([max((q @ k for k in told.get(b, [])), default=0.0) for q in mine]) if mine else 0.0
                e = said.get((u, s.book_id))
                part = ms if e is None else 3.0 * max((e @ k for k in told.get(b, [])), default=0.0) + 0.5 * ms
                parts.append(part if s.rating == "good" else -part)
        assert r.reason == pytest.approx(np.mean(parts), abs=1e-9)
        assert r.desc == pytest.approx(max(vec[s.book_id] @ vec[b] for s in rows if s.user_id == u and s.rating == "good"), abs=1e-9)


def test_counted_themes_are_those_that_fit(spark):
    """Counts without a row for each user and theme, against the rows themselves."""
    from lumenshelf.operators import feed

    kinds = ["general", "tier1+", "tier2+", "by_author", "by_l1", "by_keyword", None]
    themes = spark.createDataFrame([(k, kinds[k % 7], f"a{k % 4}" if k % 5 else None, f"l{k % 3}") for k in range(90)], "id long, personalization string, target_author string, target_l1 string")
    users = spark.createDataFrame([(u, u % 3, ["a1", "a1", "a2"][: u % 4], None if u % 5 == 0 else ["l0", "l2"]) for u in range(12)], "user_id long, tier int, top_authors array<string>, top_l1s array<string>")
    now = F.lit("2024-02-01").cast("timestamp")
    shown = spark.createDataFrame([(u, k) for u in range(12) for k in range(90) for _ in range(k % 3) if (u + k) % 4 < 2], "user_id long, curation_id long")
    shown = shown.withColumn("shown_at", now - F.when(F.col("curation_id") % 6 < 4, F.expr("interval 2 days")).otherwise(F.expr("interval 20 days")))
    # User 3 has seen every general theme.
    shown = shown.unionByName(themes.where("personalization = 'general'").select(F.lit(3).cast("long").alias("user_id"), F.col("id").alias("curation_id"), now.alias("shown_at")))
    rows = feed.not_recent(feed.fitting(users, themes), shown, now).groupBy("user_id", "personalization").agg(F.count("*").alias("n"))
    counted = feed.fitting_counts(users, themes, shown, now)
    expected = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, counted.collect())) == expected and len(expected) > 30


def test_twins_meet_one_row_a_title(spark):
    """Copies of one title joined every row of it: their product."""
    from lumenshelf.operators import ingest

    rows = [(k, f"i{k}" if k % 2 else None, " t " if k % 3 else "t", None, ["kakao", "aladin", None][k // 2 % 3] if k % 2 else None, k * 7 % 11) for k in range(400)]
    books = spark.createDataFrame(rows, "book_id long, isbn string, title string, author string, source string, created_at int")
    found = ingest.twins(books)
    best = min((r for r in rows if r[1]), key=lambda r: ({"aladin": 0, "data4library": 1, "kakao": 2}.get(r[4], 3), r[5], r[0]))[0]
    assert {(r.book_id, r.twin_id) for r in found.collect()} == {(k, best) for k in range(0, 400, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Window" not in plan


def test_a_target_is_every_row_at_its_position(spark):
    """Two rows share position 5: an update of the work that one of them leads names both, as the SQL does."""
    from lumenshelf.operators import ingest

    new = spark.createDataFrame([("11", "a b", "x", 3, 5), ("22", "c d", "y", 4, 5), ("33", "a b", "x", 9, 7)], "isbn string, title string, author string, loan_count int, pos int")
    books = spark.createDataFrame([(1, "99", "q r", "z", 1)], "book_id long, isbn string, title string, author string, loan_count int")
    got = sorted((r.pos, r.action, r.target_id, r.target_isbn) for r in ingest.actions_in_order(new, books).where("pos = 7").collect())
    assert got == [(7, "UPDATE_LOAN_COUNT", None, "11"), (7, "UPDATE_LOAN_COUNT", None, "22")]


def test_a_signal_for_a_book_that_is_nowhere_counts_for_nothing(spark):
    items, reasons, vectors, shelf, feedback, agg, _ = catalogue(spark)
    some = spark.createDataFrame([(0, 3), (0, 62), (1, 5)], "user_id long, book_id long")
    more = some.unionByName(spark.createDataFrame([(0, 999), (1, 998), (77, 997)], "user_id long, book_id long"))
    a, b = ({(r.user_id, r.book_id): r.score for r in scoring.stage_one(scoring.profiles(shelf, feedback, s, vectors, agg), items, agg, shelf, 9).collect()} for s in (some, more))
    assert a == b and len(a) == 72
    asked = shelf.select("user_id").distinct().crossJoin(items.select("book_id"))
    a, b = ({(r.user_id, r.book_id): r[2:] for r in scoring.components(asked, scoring.profiles(shelf, feedback, s, vectors, agg), shelf, feedback, items, reasons, vectors).collect()} for s in (some, more))
    assert a == b and len(a) == 480


def test_signals_are_not_shuffled(spark, sf_dir):
    """The rows of users times items stay where their users are."""
    from lumenshelf.sources import views

    plan = views.signals(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_the_catalogue_is_sent_for_cores_and_not_for_partitions(spark):
    """Every shuffle partition had a copy of the catalogue, and one block's users a second one."""
    from lumenshelf.operators import kernels

    items, _, _, shelf, _, agg, users = catalogue(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        most = max(kernels.LEAST_CELLS, kernels.CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
        assert kernels.cells_of(spark) == most < 1000
        found = scoring.stage_one(users, items, agg, shelf, 9)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [_part" in plan and f"], {most}" in plan
        # Users and items: the items are not sent a second time as what users name.
        union = plan[plan.index("Union"):]
        assert "_n0" not in union
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_what_a_profile_holds_is_not_recommended(spark, block_bytes):
    """Shelf and signals come with the profile; they were gathered, joined and sent to every block a second time."""
    items, reasons, vectors, shelf, feedback, agg, _ = catalogue(spark)
    signals = spark.createDataFrame([(u, (u * 7 + k * 5 + 3) % 60) for u in range(8) for k in range(6)], "user_id long, book_id long")
    users = scoring.profiles(shelf, feedback, signals, vectors, agg)
    taken = shelf.select("user_id", "book_id").unionByName(signals)
    for run in (
        lambda t: scoring.stage_one(users, items, agg, t, 15, block_bytes=block_bytes),
        lambda t: scoring.exact_best(users, shelf, feedback, items, reasons, vectors, t, 15, block_bytes=block_bytes),
        lambda t: scoring.near_candidates(users, items, agg, t, 15),
    ):
        one, two = ({(r.user_id, r["rank"]): (r.book_id, round(r.score, 9)) for r in run(t).collect()} for t in (taken, None))
        assert one == two and len(one) > 100
        assert not {(u, b) for (u, _), (b, _) in two.items()} & {tuple(r) for r in taken.collect()}


def test_a_family_is_sent_with_few_blocks(spark):
    """Every leader of a family had a block of its own, and each such block met the whole of the largest one."""
    from lumenshelf.llm import confirm

    rows = [(0, b) for b in range(201)] + [(j, r) for j in range(1, 51) for r in (j, 1000 + j, 2000 + j)]
    buckets = spark.createDataFrame([(0, k, r) for k, r in rows], "kind int, key long, rep long")
    stars = spark.createDataFrame([(0 if k == 0 else k, r) for k, r in rows if r != k], "lead long, rep long")
    links = spark.createDataFrame([], "a long, b long")
    classes = buckets.select("rep").distinct().withColumn("n_shingles", F.lit(10).cast("long"))
    found = confirm._open_blocks(buckets, stars, links, classes).collect()
    assert len(found) < 1000
    # Sets that share a bucket meet in a pair of blocks.
    met = {}
    for r in found:
        met.setdefault((r.lead, r["sub"], r.other_lead, r.other_sub), set()).add(r.rep)
    for k in range(51):
        mine = [r for key, r in rows if key == k]
        assert all(any({mine[0], r} <= pair for pair in met.values()) for r in mine)


def test_scores_held_at_once_are_few():
    """Several copies of 32 MB of scores were held by each Python worker."""
    import tracemalloc

    import pyarrow as pa

    from lumenshelf.operators import kernels

    rng = np.random.default_rng(3)
    n, m, dims = 20000, 600, 8
    block = kernels.Block((np.arange(n), rng.normal(size=(n, dims)), np.ones(n), np.arange(n)))
    queries = pa.RecordBatch.from_arrays([pa.array(range(m)), pa.array(list(rng.normal(size=(m, dims)))), pa.array([[q] for q in range(m)])], names=["query_id", "vec", "exclude"])
    run, _ = kernels.nearest_of_block(block, dims, 5)
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([queries]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5 * m and most < 60 << 20
    q, row = np.array(queries.column("vec").to_pylist())[7], found.slice(35, 5)
    score = block.value[1] @ q
    score[7] = -np.inf
    assert row.column("book_id").to_pylist() == np.argsort(-score, kind="stable")[:5].tolist()


def test_listed_signals_are_not_made_rows(spark):
    """Lists of signals became a row for each user and book and were gathered again, which spilled."""
    items, _, vectors, shelf, feedback, agg, _ = catalogue(spark)
    # Book 62 is outside of the index; user 9 has no shelf.
    rows = spark.createDataFrame([(u, b) for u in [*range(0, 8, 2), 9] for b in (62, u, 3 * u + 1)], "user_id long, book_id long")
    lists = rows.groupBy("user_id").agg(F.collect_list("book_id").alias("book_ids"))
    one, two = (scoring.profiles(shelf, feedback, s, vectors, agg) for s in (rows, lists))
    got = sorted(map(str, one.collect()))
    assert got == sorted(map(str, two.collect())) and len(got) == 9
    some = one.where("user_id = 9").first()
    assert some.avoid == [9, 28, 62] and some.own_ids == [62] and some.own_vec[0] == vectors.where("book_id = 62").first().vec and some.seen == [] and some.fb_vec == []
    listed = lists.localCheckpoint()
    assert "avoid" in (plan := scoring.profiles(shelf, feedback, listed, vectors, agg)._jdf.queryExecution().optimizedPlan().toString()) and "Generate" not in plan


def test_what_is_not_recommended_is_sent_once(spark):
    """Each user's row held the signals twice: as what counts against a book and as what is taken."""
    items, _, _, _, _, agg, users = catalogue(spark)
    rows = scoring._gone(users, None, "taken").first()
    assert sorted(rows.taken) == sorted(rows.seen)


def test_many_signals_meet_a_block_in_pieces():
    """All products of a user's 3,000 signals and 20,000 books were held at once: 480 MB."""
    import tracemalloc

    import pyarrow as pa

    from lumenshelf.operators import kernels

    rng = np.random.default_rng(3)
    n, m, dims = 20000, 3000, 4
    vectors, first = rng.normal(size=(n, dims)), np.arange(n + 1)
    block = kernels.Block((np.arange(n), vectors, vectors, first, np.ones(n)), (np.arange(n), vectors, vectors, first))
    ids = {"user_id": [1], "good": [[5, 9]], "bad": [[7]], "wish": [[]], "avoid": [list(range(100, 100 + m))], "own_ids": [[]], "fb_ids": [[]], "candidates": [[5, 7, 9]]}
    columns = {k: pa.array(v, pa.int64() if k == "user_id" else pa.list_(pa.int64())) for k, v in ids.items()}
    columns |= {"own_vec": pa.array([[]], pa.list_(pa.list_(pa.float64()))), "fb_vec": pa.array([[]], pa.list_(pa.list_(pa.float64()))), "fb_sign": pa.array([[]], pa.list_(pa.float64()))}
    run, _ = kernels.components_of(block, dims, "engine", 3.0, 0.5, lambda reason, desc, bad, heard, wish, avoid, factor: desc - avoid, 6, ("candidates", "avoid"))
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pydict(columns)]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = (vectors @ vectors[[5, 9]].T).max(axis=1) - (vectors @ vectors[100 : 100 + m].T).max(axis=1)
    score[[5, 7, 9, *range(100, 100 + m)]] = -np.inf
    assert found.column("book_id").to_pylist() == np.argsort(-score, kind="stable")[:6].tolist() and most < 60 << 20


def test_all_reasons_meet_once(spark):
    """All reasons met all markers a second time for the genres of the books found."""
    from lumenshelf.operators import bridge

    marks = spark.createDataFrame([(1, 5, 1.0, [1.0, 0.0])], "user_id long, marker_id long, weight double, vec array<double>")
    reasons = spark.createDataFrame([(b, b * 10, f"r{b}", [1.0, float(b)]) for b in range(4)], "book_id long, reason_pos long, reason string, vec array<double>")
    books = spark.createDataFrame([(b, f"g{b % 2}>h") for b in range(4)], "book_id long, genre string")
    found = bridge.by_all_reasons(marks, reasons, spark.createDataFrame([(1, 3)], "user_id long, book_id long"), books)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.book_id for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_few_products_of_all_reasons_are_held():
    """Books whose mean is greatest, with the marker and reason of each, against a plain loop; books of unequal numbers of reasons too."""
    import tracemalloc

    import pyarrow as pa

    from lumenshelf.operators import kernels

    rng = np.random.default_rng(4)
    for lengths in (np.full(5000, 3), rng.integers(1, 12, 5000)):
        first = np.concatenate([[0], np.cumsum(lengths)])
        vectors = rng.normal(size=(first[-1], 4))
        marks = [rng.normal(size=(k, 4)) for k in (200, 3, 1)]
        batch = pa.RecordBatch.from_pydict({"user_id": pa.array([1, 2, 3]), "markers": pa.array([m.tolist() for m in marks]), "marker_ids": pa.array([list(range(len(m))) for m in marks]), "exclude": pa.array([[0], [1, 2], [3]])})
        run, _ = kernels.mean_best_of_block(kernels.Block((np.arange(5000), first, vectors, np.arange(first[-1]) * 2)), 4, 6, 1.0)
        tracemalloc.start()
        found = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 12 << 20
        for u, (m, gone) in enumerate(zip(marks, ([0], [1, 2], [3])), 1):
            sims = m @ vectors.T
            total = np.maximum.reduceat(sims, first[:-1], axis=1).sum(axis=0)
            total[gone] = -np.inf
            expected = {}
            for b in np.argsort(-total)[:6]:
                k, r = np.unravel_index(sims[:, first[b] : first[b + 1]].argmax(), (len(m), lengths[b]))
                expected[int(b)] = (round(total[b], 9), int(k), int(first[b] + r) * 2)
            assert {r["book_id"]: (round(r["sim"], 9), r["marker_id"], r["reason_pos"]) for r in found if r["user_id"] == u} == expected


def test_signals_travel_as_differences(spark):
    """A profile's signals were eight bytes each in its table, and again wherever it was sent."""
    from lumenshelf.operators import kernels
    from lumenshelf.operators.saved import written

    lists = [list(range(k, 40000, 37)) for k in range(400)] + [[], [5], [9, 2, -3, 2**40], [4, None, 7], None]
    users = spark.createDataFrame(list(enumerate(lists)), "user_id long, avoid array<bigint>")
    wanted = {k: [x for x in v or [] if x is not None] for k, v in enumerate(lists)}
    held = kernels.packed(users, "avoid")
    assert {r.user_id: r.avoid for r in kernels.unpacked(held, "avoid").collect()} == wanted
    assert {r.user_id: r.n for r in held.select("user_id", kernels.sizes(held, "avoid").alias("n")).collect()} == {k: len(v) for k, v in wanted.items()}
    files = lambda d: sum(len(f.content) for f in spark.read.format("binaryFile").load(d.inputFiles()).select("content").collect())
    assert files(written(held.coalesce(1))) < files(written(users.coalesce(1))) / 4


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_packed_profiles_give_the_same_rows(spark, block_bytes):
    from lumenshelf.operators import kernels

    items, reasons, vectors, shelf, feedback, agg, users = catalogue(spark)
    asked = users.select("user_id").crossJoin(items.select("book_id"))
    for run in (
        lambda u: scoring.stage_one(u, items, agg, None, 15, block_bytes=block_bytes),
        lambda u: scoring.exact_best(u, shelf, feedback, items, reasons, vectors, None, 15, block_bytes=block_bytes),
        lambda u: scoring.components(asked, u, shelf, feedback, items, reasons, vectors, block_bytes=block_bytes),
    ):
        one, two = (sorted([round(x, 9) for x in r] for r in run(u).collect()) for u in (users, kernels.packed(users, "avoid")))
        assert one == two and len(one) > 100


def test_each_cell_has_a_partition(spark):
    """Cells were dealt by a hash of their numbers: some tasks had several, others none, so three times as many were needed."""
    from lumenshelf.operators import kernels

    for n in (7, 12, 60):
        cells = spark.range(n).withColumn("_partition", kernels._own_partitions(spark, n, F.col("id"))).repartition(n, "_partition")
        assert cells.groupBy(F.spark_partition_id()).count().count() == n
    assert kernels.CELLS_PER_CORE == 1


def lists(spark):
    """Lists of 120 books in 7 genres, liked books of some users, and the items."""
    rng = np.random.default_rng(6)
    items = spark.createDataFrame([(b, f"L{b * b % 7}", f"a{b % 5}" if b % 9 else None, rng.normal(size=3).tolist()) for b in range(200)], "book_id long, l1 string, author string, desc array<double>")
    ranked = spark.createDataFrame([(u, k + 1, int(b), 1.0 - k / 120) for u in range(6) for k, b in enumerate(rng.permutation(200)[:120])], "user_id long, rank int, book_id long, score double")
    liked = spark.createDataFrame([(u, int(b)) for u in range(1, 6) for b in rng.permutation(200)[: u * 3 - 2]], "user_id long, book_id long")
    return items, ranked, liked


def test_lists_are_cut_before_they_are_shuffled(spark):
    """All candidates were shuffled three times, by book, by genre and by user, to keep twenty of them."""
    from lumenshelf.operators import taste, variants

    items, ranked, liked = lists(spark)
    carried = ranked.join(items.select("book_id", "l1", "author"), "book_id")
    genre = {r.book_id: r.l1 for r in items.collect()}
    by, share = {}, {}
    for r in ranked.orderBy("rank").collect():
        by.setdefault(r.user_id, []).append(r.book_id)
    for r in liked.collect():
        share.setdefault(r.user_id, []).append(genre[r.book_id])
    closed, open_, auto = set(), set(), set()
    for u, own in by.items():
        g = share.get(u, [])
        quota = {x: max(1, round(g.count(x) / len(g) * 20)) for x in g}
        rest = max(0, 20 - sum(quota.values())) if g else None

        def fitting(limit):
            seen, out = {}, []
            for b in own:
                seen[genre[b]] = seen.get(genre[b], 0) + 1
                if (n := limit(genre[b])) is None or seen[genre[b]] <= n:
                    out.append(b)
            return out

        kept = fitting(lambda x: quota.get(x))[:20]
        closed |= {(u, k, b) for k, b in enumerate(kept, 1)}
        auto |= {(u, k, b) for k, b in enumerate(kept if len(g) >= 4 and len(set(g)) > 1 else own[:20], 1)}
        first = fitting(lambda x: quota.get(x, rest))[:20]
        open_ |= {(u, k, b) for k, b in enumerate((first + [b for b in own if b not in first])[:20], 1)}
    for run, expected in ((taste.quota_rerank, closed), (variants.open_quota_rerank, open_), (variants.auto_rerank, auto)):
        found = run(carried, liked, items, 20)
        assert {(r.user_id, r["rank"], r.book_id) for r in found.collect()} == {(r.user_id, r["rank"], r.book_id) for r in run(ranked, liked, items, 20).collect()} == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan


def test_mmr_sends_ids_and_no_vector_a_row(spark):
    """Each of a user's hundred candidates was shuffled with its vector."""
    from lumenshelf.operators import taste

    items, ranked, _ = lists(spark)
    found = taste.mmr_rerank(ranked, items, 8)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    vec = {r.book_id: np.array(r.desc) for r in items.collect()}
    rows = {}
    for r in ranked.where("rank <= 100").orderBy("rank").collect():
        rows.setdefault(r.user_id, []).append((r.book_id, r.score))
    expected = set()
    for u, own in rows.items():
        chosen = []
        while len(chosen) < 8:
            left = [(0.6 * s - 0.4 * 5.0 * max((vec[b] @ vec[c] for c in chosen), default=0.0), b) for b, s in own if b not in chosen]
            chosen.append(max(left)[1])
        expected |= {(u, k, b) for k, b in enumerate(chosen, 1)}
    assert {(r.user_id, r["rank"], r.book_id) for r in found.collect()} == expected
    before, taste.MMR_BYTES = taste.MMR_BYTES, 300
    try:
        assert {(r.user_id, r["rank"], r.book_id) for r in taste.mmr_rerank(ranked, items, 8).collect()} == expected
    finally:
        taste.MMR_BYTES = before


def test_a_mean_makes_no_row_for_each_number(spark):
    """Every number of every vector became a row and a key of its own; vectors of several lengths, weights of 0, nulls and empty ones."""
    from lumenshelf.functions.vectors import weighted_mean

    rows = [(1, 2.0, [1.0, 2.0]), (1, 1.0, [4.0, 5.0]), (1, 0.0, [9.0, 9.0]), (2, 1.0, [1.0, 2.0, 3.0]), (2, 3.0, [5.0]), (3, 0.0, [1.0]), (4, 1.0, None), (4, 1.0, []), (5, None, [1.0])]
    found = weighted_mean(spark.createDataFrame(rows, "k long, w double, v array<double>"), ["k"], "v", F.col("w"))
    assert {r.k: [round(x, 9) for x in r.vec] for r in found.collect()} == {1: [2.0, 3.0], 2: [4.0, 2.0, 3.0]}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_one_list_for_all_makes_no_row_for_each_user_and_book(spark):
    """The list was joined with every user before a shelf was taken off; unseen, half seen, over-long and null users, and a book listed twice."""
    from lumenshelf.operators import feed
    from lumenshelf.operators.blocks import against_all

    books = spark.createDataFrame([(b, None if b % 13 == 0 else "" if b % 7 == 0 else "c") for b in range(80)], "book_id long, cover_url string")
    listed = spark.createDataFrame([(b * 7 % 11, b) for b in range(90)] + [(3, 5), (3, 5), (9, 8)], "rank int, book_id long")
    seen = spark.createDataFrame([(u, b) for u in range(8) for b in range(90) if (u + b) % 8 < u for _ in range(b % 2 + 1)] + [(None, 4), (9, None)] + [(10, b) for b in range(80)], "user_id long, book_id long")
    users = seen.select("user_id").unionByName(spark.createDataFrame([(20,)], "user_id long"))
    found = feed.filled_from_one(users, listed, seen, books, 10)
    plain = feed.filled(against_all(users.distinct(), listed, "book_id"), seen, books, 10)
    a, b = (sorted(map(tuple, x.select("user_id", "rank", "book_id").collect()), key=repr) for x in (found, plain))
    assert a == b and len(a) > 90 and {r[0] for r in a} >= {None, 9, 20} and 10 not in {r[0] for r in a}
    assert found.schema["rank"].dataType == plain.schema["rank"].dataType
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "_block" not in plan


def test_scores_of_candidates_are_made_where_their_parts_are(spark):
    """Each candidate was shuffled with six parts to find its tier, lists went through rows, and modes and weightings through all candidates anew."""
    from lumenshelf.operators.blocks import top_per

    items, reasons, vectors, shelf, feedback, agg, users = catalogue(spark)
    items = items.withColumn("source_tier", F.when(F.col("book_id") % 2 == 0, "minimal").otherwise("rich"))
    rows = scoring.stage_one(users, items, agg, None, 15)
    for block_bytes in (1 << 20, 300):
        lists = scoring.stage_one(users, items, agg, None, 15, block_bytes=block_bytes, through=scoring.PROFILE)
        args = (users, items, reasons, vectors)
        one = {(r.user_id, r.book_id): r for r in scoring.components(rows, users, shelf, feedback, items, reasons, vectors).collect()}
        two = {(r.user_id, r.book_id): r.score for r in scoring.stage_two(lists, users, shelf, feedback, items, reasons, vectors, block_bytes=block_bytes).collect()}
        for (u, b), r in one.items():
            total = 2 * r.reason + 3 * r.desc + 2 * r.heard + r.wish - 0.75 * r.avoid
            assert two[u, b] == pytest.approx(total * 0.85 if total > 0 and b % 2 == 0 else total, abs=1e-9)
        assert two.keys() == one.keys() and len(one) == 120
        found = {(r.user_id, r.book_id, r["mode"]): r.reason for r in scoring.reason_modes(lists, *args, ("engine", "filter"), block_bytes).collect()}
        plain = {(r.user_id, r.book_id, m): r.reason for m in ("engine", "filter") for r in scoring.components(rows, users, shelf, feedback, items, reasons, vectors, m).collect()}
        assert found == {k: pytest.approx(v, abs=1e-9) for k, v in plain.items()}
        grid = spark.createDataFrame([("a", 1.0, 0.5, 2.0), ("b", 2.0, 3.0, 0.0)], "name string, reason_w double, desc_w double, fb_w double")
        scored = scoring.weight_grid(scoring.components(rows, users, shelf, feedback, items, reasons, vectors, "evaluation"), grid)
        expected = {(r.name, r.user_id, r["rank"]): r.book_id for r in top_per(scored, ["name", "user_id"], [F.desc("score"), "book_id"], 3).collect()}
        assert {(r.name, r.user_id, r["rank"]): r.book_id for r in scoring.best_by_weights(lists, *args, grid, 3, block_bytes).collect()} == expected and len(expected) == 48
    plan = scoring.stage_two(lists, users, shelf, feedback, items, reasons, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_vectors_travel_in_single_precision_where_that_loses_nothing(spark):
    from lumenshelf.operators import kernels

    rows = [(1, [0.5, 0.25], [[0.5, 1.0]]), (2, [0.1, 1.0], []), (3, [2.0, float("inf")], [[0.1, 0.2], [3.0, 4.0]])]
    kept = spark.createDataFrame(rows, "k long, v array<double>, m array<array<double>>")
    table = kernels.narrow(kept, "v", "m").orderBy("k").toArrow()
    assert [r["f"] is None for r in table.column("v").to_pylist()] == [False, True, False]
    assert kernels.vectors_of(table, "v", 2).tolist() == [r[1] for r in rows]
    m, starts = kernels.matrices(table.column("m"), 2)
    assert m.tolist() == [v for r in rows for v in r[2]] and starts.tolist() == [0, 1, 1, 3]
    exact = kernels.narrow(kept.where("k = 1"), "v").toArrow()
    assert kernels.vectors_of(exact, "v", 2).dtype == np.float32


def test_signals_count_only_for_books_that_can_be_among_the_best():
    """All products of a user's signals and all books were made to find a few books."""
    import pyarrow as pa

    from lumenshelf.operators import kernels

    rng = np.random.default_rng(4)
    n, m, dims = 5000, 700, 6
    vectors, first = rng.normal(size=(n, dims)), np.arange(n + 1)
    block = kernels.Block((np.arange(n), vectors, vectors, first, np.ones(n)), (np.arange(n), vectors, vectors, first))
    avoid = rng.choice(np.arange(10, n), m, replace=False).tolist()
    ids = {"user_id": [1], "good": [[5, 9]], "bad": [[7]], "wish": [[]], "avoid": [avoid], "own_ids": [[]], "fb_ids": [[]], "candidates": [[5, 7, 9]]}
    columns = {k: pa.array(v, pa.int64() if k == "user_id" else pa.list_(pa.int64())) for k, v in ids.items()}
    columns |= {"own_vec": pa.array([[]], pa.list_(pa.list_(pa.float64()))), "fb_vec": pa.array([[]], pa.list_(pa.list_(pa.float64()))), "fb_sign": pa.array([[]], pa.list_(pa.float64()))}
    asked = []

    def score(reason, desc, bad, heard, wish, avoid, factor):
        asked.append(len(desc))
        return (desc - avoid,)

    run, _ = kernels.components_of(block, dims, "engine", 3.0, 0.5, n=6, gone=("candidates", "avoid"), scores=score, others=True, lazy=True)
    found = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pydict(columns)]))))
    truth = (vectors @ vectors[[5, 9]].T).max(axis=1) - (vectors @ vectors[avoid].T).max(axis=1)
    truth[[5, 7, 9, *avoid]] = -np.inf
    assert found.column("book_id").to_pylist() == np.argsort(-truth, kind="stable")[:6].tolist()
    assert np.allclose(found.column("score").to_numpy(), np.sort(truth)[::-1][:6]) and sum(asked[1:]) < asked[0] / 2


def test_all_reasons_give_no_more_than_is_asked_for():
    """A block gave every book that could be among the best after the greatest boost, which were most of the catalogue for each user."""
    import pyarrow as pa

    from lumenshelf.operators import kernels

    rng = np.random.default_rng(6)
    n, dims = 4000, 4
    vectors, kind = kernels.unit_rows(rng.normal(size=(n, dims)).astype(np.float32)), np.arange(n) % 3
    block = kernels.Block((np.arange(n), np.arange(n + 1), vectors, np.arange(n), kind, [{"a"}, {"a", "b"}, set()]))
    marks = rng.normal(size=(3, dims))
    batch = pa.RecordBatch.from_pydict({"user_id": pa.array([1]), "markers": pa.array([marks.tolist()]), "marker_ids": pa.array([[0, 1, 2]]), "exclude": pa.array([[7]]), "parts": pa.array([["a", "b", "c"]])})
    run, _ = kernels.mean_best_of_block(block, dims, 6, 1.3, 0.1)
    found = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    score = (kernels.unit_rows(marks) @ vectors.T).sum(axis=0) * (1 + np.array([0.1, 0.2, 0.0])[kind])
    score[7] = -np.inf
    assert sorted(r["book_id"] for r in found) == sorted(np.argsort(-score)[:6].tolist()) and {r["axes"] for r in found} == {3}
    assert all(r["boost"] == [0.1, 0.2, 0.0][r["book_id"] % 3] for r in found)


def test_listed_signals_are_hashed_where_they_are(spark):
    """Each signal became a row, its text was gathered again, and the lists were sorted to be joined."""
    from lumenshelf.operators import catalogue as made

    shelf = spark.createDataFrame([(u, b, ("good", None)[b % 2], "finished") for u in range(6) for b in range(4)], "user_id long, book_id long, rating string, status string")
    told = shelf.where("book_id = 2").select("user_id", "book_id")
    rows = spark.createDataFrame([(u, b, "x") for u in (0, 2, 4, 9) for b in range(30 - u)], "user_id long, book_id long, signal string")
    lists = rows.groupBy("user_id").agg(F.collect_list("book_id").alias("book_ids")).withColumn("signal", F.lit("x"))
    lists = lists.unionByName(spark.createDataFrame([(11, [], "x")], "user_id long, book_ids array<bigint>, signal string"))
    one, two = (sorted(map(tuple, made.input_hash(shelf, told, s).collect())) for s in (rows, lists))
    assert one == two and len(one) == 7
    plan = made.input_hash(shelf, told, lists.localCheckpoint())._jdf.queryExecution().toString()
    assert "Generate" not in plan and "ShuffledHashJoin" in plan
