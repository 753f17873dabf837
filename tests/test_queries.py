"""Every registered query against its SQL, and what SQL cannot state against fixtures."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.support import differences

import __spark_entry__ as entry
from lumenshelf import plans
from lumenshelf.functions import text as T
from lumenshelf.functions import vectors as V
from lumenshelf.operators import activity, scoring, similar
from lumenshelf.operators.blocks import against_all


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(plans.queries()[name](spark, sf_dir), plans.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "rank", "book_id", "score"] or set(found.columns) == {"query_id", "rank", "book_id", "score"}
    assert found.count() == 10


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage():
    """The entry module works where the subpackage and the pipeline are absent."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lumenshelf.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title,author,key", [("동물농장 (양장)", "조지 오웰 (지은이), X", "동물농장|조지오웰"), ("A B: c", None, "ab|"), ("(x)", "y", None), (None, "y", None)])
def test_work_key(spark, title, author, key):
    assert value(spark, T.work_key(F.lit(title).cast("string"), F.lit(author).cast("string"))) == key


def test_vectors_of_length_zero(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, V.unit(zero)) == [0.0, 0.0] and value(spark, V.unit(one)) == [0.6, 0.8] and value(spark, V.cosine(zero, one)) == 0.0


def test_max_sim_of_nothing_is_zero(spark):
    none, some = F.array().cast("array<array<double>>"), F.array(F.array(F.lit(1.0)))
    assert value(spark, V.max_sim(none, some)) == 0.0 and value(spark, V.max_sim(some, none)) == 0.0


def test_penalty_spares_negative_scores(spark):
    assert value(spark, similar.penalised(F.lit(-1.0), F.lit("minimal"))) == -1.0
    assert value(spark, similar.penalised(F.lit(2.0), F.lit("minimal"))) == 1.7


def test_blocks_hold_every_pair_once(spark):
    q, r = spark.range(7).select(F.col("id").alias("q")), spark.range(50).select(F.col("id").alias("r"))
    assert against_all(q, r, "r", 8).distinct().count() == 350 and against_all(q, r, "r", 8).count() == 350


def world(spark, shelf, feedback=(), signals=(), tiers=None):
    vec = {0: [1.0, 0.0], 1: [0.8, 0.6], 2: [0.0, 1.0], 3: [-1.0, 0.0], 9: [0.6, 0.8]}
    items = spark.createDataFrame([(b, v, (tiers or {}).get(b, "rich")) for b, v in vec.items() if b != 9], "book_id long, desc array<double>, source_tier string")
    vectors = spark.createDataFrame(list(vec.items()), "book_id long, vec array<double>")
    reasons = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [1.0, 0.0])], "book_id long, reason_pos long, vec array<double>")
    s = spark.createDataFrame(list(shelf), "user_id long, book_id long, rating string, status string")
    f = spark.createDataFrame(list(feedback), "user_id long, book_id long, rating string, vec array<double>")
    n = spark.createDataFrame(list(signals), "user_id long, book_id long")
    agg = scoring.aggregate_reasons(items, reasons)
    return items, vectors, reasons, s, f, agg, scoring.profiles(s, f, n, vectors, agg), s.select("user_id", "book_id").union(n)


def stage_one(spark, *args, **kw):
    items, _, _, _, _, agg, users, taken = world(spark, *args, **kw)
    return {(r.user_id, r.book_id): r.score for r in scoring.stage_one(users, items, agg, taken).collect()}


def test_only_dislikes_give_no_candidates(spark):
    assert stage_one(spark, [(1, 0, "bad", "finished")]) == {}


def test_scaling_covers_taken_items(spark):
    """Item 3 has the least value and item 0, which is taken, the greatest."""
    got = stage_one(spark, [(1, 0, "good", "finished")])
    assert (1, 0) not in got and got[(1, 3)] == pytest.approx(0.0, abs=1e-6) and got[(1, 1)] < 2.0


def test_a_book_outside_the_index_counts_without_reasons(spark):
    assert set(stage_one(spark, [(1, 9, "good", "finished")])) == {(1, b) for b in (0, 1, 2, 3)}


def test_a_book_that_is_nowhere_counts_for_nothing(spark):
    assert stage_one(spark, [(1, 777, "good", "finished")]) == {}


def test_neutral_feedback_is_left_out_and_unrated_feedback_is_liked(spark):
    base = [(1, 0, "good", "finished")]
    plain = stage_one(spark, base)
    assert stage_one(spark, base, [(1, 2, "neutral", [0.0, 1.0])]) == plain
    liked = stage_one(spark, base, [(1, 2, None, [0.0, 1.0])])
    assert liked[(1, 2)] > plain[(1, 2)]


def stage_two(spark, shelf, feedback=(), signals=(), candidates=((1, 1), (1, 2), (1, 3)), tiers=None):
    items, vectors, reasons, s, f, _, users, _ = world(spark, shelf, feedback, signals, tiers)
    c = spark.createDataFrame(list(candidates), "user_id long, book_id long")
    return {r.book_id: r.score for r in scoring.stage_two(c, users, s, f, items, reasons, vectors).collect()}


def test_stage_two_by_hand(spark):
    got = stage_two(spark, [(1, 0, "good", "finished")])
    assert got == {1: pytest.approx(2 * 1.0 + 3 * 0.8), 2: pytest.approx(0.0), 3: pytest.approx(-3.0)}


def test_stage_two_penalises_positive_scores_only(spark):
    got = stage_two(spark, [(1, 0, "good", "finished")], tiers={1: "minimal", 3: "minimal"})
    assert got[1] == pytest.approx(0.85 * 4.4) and got[3] == pytest.approx(-3.0)


def test_stage_two_of_only_dislikes(spark):
    assert stage_two(spark, [(1, 0, "bad", "finished")]) == {1: pytest.approx(-2.0), 2: pytest.approx(0.0), 3: pytest.approx(0.0)}


def test_unrated_reasons_count_in_the_mean(spark):
    """Item 2 has no reasons, so its MaxSim with item 1 is 0 and halves the mean."""
    got = stage_two(spark, [(1, 0, "good", "finished"), (1, 2, "good", "finished")], candidates=[(1, 1)])
    assert got[1] == pytest.approx(2 * 0.5 + 3 * 0.8)


def test_signals_enter_stage_two_as_a_maximum(spark):
    got = stage_two(spark, [(1, 0, "good", "finished"), (1, 2, None, "wishlist")], signals=[(1, 3)], candidates=[(1, 1)])
    assert got[1] == pytest.approx(2.0 + 2.4 + 0.6 + 0.75 * 0.8)


def test_transitions_tell_nulls_apart(spark):
    rows = [(1, 1, None, 1), (1, 1, "good", 2), (1, 1, "good", 3), (1, 1, None, 4), (1, 2, "bad", 5)]
    e = spark.createDataFrame([(*r[:3], r[3], r[3]) for r in rows], "user_id long, book_id long, state string, at long, event_id long")
    assert sorted((r.event_id, r.old, r.new) for r in activity.transitions(e).collect()) == [(2, None, "good"), (4, "good", None)]
