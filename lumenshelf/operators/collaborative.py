"""Item-to-item similarity from shared likes, and its blend with content scores by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Active users and pairs liked together that each stage needs.
STAGE_USERS = {1: 100, 2: 300, 3: 500}
STAGE_PAIRS = {1: 200, 2: 1000, 3: 3000}
#: Weight of content and of shared likes; in stage 1 the latter are added on top.
STAGE_WEIGHTS = {0: (1.0, 0.0), 1: (1.0, 0.2), 2: (0.6, 0.4), 3: (0.4, 0.6)}
#: Users that a pair must share to count.
STAGE_LEAST = {0: 3, 1: 3, 2: 5, 3: 10}
# ----------------------------------------------------------------------------
#: Rows of one user on one side of a block of pairs.
PAIR_BLOCK = 256
#: Users that a similarity is drawn towards zero by.
SHRINK = 10.0


def pairs_within(rows: DataFrame, group: str, item: str, block_rows: int = PAIR_BLOCK) -> DataFrame:
    """Each unordered pair of a group's rows once, as structs x and y with x.item < y.item.

    Rows of a group are dealt to blocks of about `block_rows`, and a pair of
    blocks is one key of the join, so a group of any size spreads over all
    tasks. Items must be unique inside a group.
    """
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    dealt = rows.select(F.col(group).alias("_g"), F.struct(*rows.columns).alias("_row")).join(blocks.withColumnRenamed(group, "_g"), "_g")
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(F.col("_row")[item]), F.col("_n")).cast("int"))
    x = dealt.select("_g", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_j"), F.col("_row").alias("p"))
    y = dealt.select("_g", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"), F.col("_row").alias("q"))
    # A fixed number of partitions: by its size alone the input would be merged into few tasks, or broadcast.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = x.repartition(tasks, "_g", "_i", "_j"), y.repartition(tasks, "_g", "_i", "_j")
    both = x.hint("merge").join(y, ["_g", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("p")[item] < F.col("q")[item]))
    first = F.col("p")[item] < F.col("q")[item]
    return both.select(F.col("_g").alias(group), F.when(first, F.col("p")).otherwise(F.col("q")).alias("x"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("y"))


def item_similarity(likes: DataFrame, least: int = STAGE_LEAST[1], shrink: float = SHRINK, block_rows: int = PAIR_BLOCK) -> DataFrame:
    """a, b, shared, similarity of books a < b that at least `least` users like both.

    likes(user_id, book_id) is the sparse user-item matrix; rows with a null
    and repeated rows count for nothing. Similarity is the cosine of two
    columns, shared / sqrt(likes of a * likes of b), times shared / (shared +
    shrink). A book with less than `least` likes is in no pair, so it is left
    out before pairs form.
    """
    known = likes.select("user_id", "book_id").where("user_id is not null and book_id is not null").distinct()
    counts = known.groupBy("book_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pairs = pairs_within(known.join(counts, "book_id", "left_semi"), "user_id", "book_id", block_rows)
    shared = pairs.groupBy(F.col("x.book_id").alias("a"), F.col("y.book_id").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    both = shared.join(counts.select(F.col("book_id").alias("a"), F.col("n").alias("_a")), "a").join(counts.select(F.col("book_id").alias("b"), F.col("n").alias("_b")), "b")
    similarity = F.col("shared") / F.sqrt(F.col("_a").cast("double") * F.col("_b")) * F.col("shared") / (F.col("shared") + shrink)
    return both.select("a", "b", "shared", similarity.alias("similarity"))


def cf_scores(likes: DataFrame, similar: DataFrame, taken: DataFrame, least: int = STAGE_LEAST[1]) -> DataFrame:
    """user_id, book_id, score: the similarities of a user's liked books to a book, added up and divided by the number of liked books.

    Pairs that share less than `least` users add nothing; books in
    taken(user_id, book_id) are left out.
    """
    known = likes.select("user_id", "book_id").where("user_id is not null and book_id is not null").distinct()
    near = similar.where(F.col("shared") >= least)
    near = near.select("a", "b", "similarity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    sums = known.join(near, F.col("book_id") == F.col("a")).groupBy("user_id", F.col("b").alias("book_id")).agg(F.sum("similarity").alias("_s"))
    sums = sums.join(taken.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    size = known.groupBy("user_id").agg(F.count("*").alias("_n"))
    return sums.join(size, "user_id").select("user_id", "book_id", (F.col("_s") / F.col("_n")).alias("score"))


def stage_of(user_state: DataFrame, similar: DataFrame) -> DataFrame:
    """One row (users, pairs, stage): the highest stage whose numbers of active users and of pairs liked together are reached, with all below it."""
    users = user_state.agg(F.count_if("is_active").alias("users"))
    pairs = similar.agg(F.count_if(F.col("shared") >= STAGE_LEAST[1]).alias("pairs"))
    stage = F.lit(0)
    for s in sorted(STAGE_USERS):
        stage = F.when((stage == s - 1) & (F.col("users") >= STAGE_USERS[s]) & (F.col("pairs") >= STAGE_PAIRS[s]), s).otherwise(stage)
    # Two tables of one row each.
    return users.crossJoin(pairs).select("users", "pairs", stage.alias("stage"))


def _scaled(rows: DataFrame, name: str) -> DataFrame:
    bounds = rows.groupBy("user_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return rows.join(bounds, "user_id").select("user_id", "book_id", ((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias(name))


def blend(content: DataFrame, cf: DataFrame, stage: int | Column) -> DataFrame:
    """user_id, book_id, score, content, cf: both scores brought to 0..1 per user and mixed by the stage's weights.

    content and cf have user_id, book_id, score. A book that has only one of
    them gets 0 for the other, and a user's only book 0 in that score.
    """
    both = _scaled(content, "content").join(_scaled(cf, "cf"), ["user_id", "book_id"], "full").select("user_id", "book_id", F.coalesce("content", F.lit(0.0)).alias("content"), F.coalesce("cf", F.lit(0.0)).alias("cf"))
    stage = stage if isinstance(stage, Column) else F.lit(stage)
    score = F.coalesce(*(F.when(stage == s, c * F.col("content") + w * F.col("cf")) for s, (c, w) in STAGE_WEIGHTS.items()))
    return both.select("user_id", "book_id", score.alias("score"), "content", "cf")
