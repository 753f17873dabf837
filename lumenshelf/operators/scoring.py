"""Two-stage personal recommendation, over all users in one job.

Stage 1 rates every item for every user; stage 2 rates the candidates
precisely, from the reasons of rated books. Both run as matrix products of a
batch of users with a block of items (`kernels`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit, weighted_mean
from . import kernels
from .blocks import BLOCK_ROWS, top_per
from .saved import written
from .similar import TIER_FACTOR


@dataclass(frozen=True)
class Weights:
    """Fixed values of both stages."""

    desc: float = 3.0
    reason: float = 2.0
    feedback: float = 2.0
    bad: float = 1.5
    wishlist: float = 1.0
    not_interested: float = 0.75
    match: float = 3.0
    rest: float = 0.5


# --- fixed values -----------------------------------------------------------
CANDIDATES = 700
#: Bytes of a block of books here: users, who are many and name many books, are sent once for each block.
BOOK_BYTES = 128 << 20
#: Blocks of books that users name which a task holds at once; fewer are sent again more often.
NAMED_BLOCKS = 2
#: Weight of a user's own words, and of a book's reasons beside them, by mode.
MODES = {"engine": (3.0, 0.5), "feedback": (5.0, 0.2), "filter": (2.0, 2.0), "user": (3.0, 0.0), "evaluation": (0.0, 1.0)}
# ----------------------------------------------------------------------------


def aggregate_reasons(items: DataFrame, reasons: DataFrame) -> DataFrame:
    """(book_id, agg): unit mean of an item's reason vectors; the zero vector without reasons."""
    mean = weighted_mean(reasons, ["book_id"], "vec").select("book_id", unit("vec").alias("agg"))
    zero = F.transform("desc", lambda x: F.lit(0.0))
    return items.select("book_id", "desc").join(mean, "book_id", "left").select("book_id", F.coalesce("agg", zero).alias("agg"))


def _none() -> Column:
    return F.array().cast("array<array<double>>")


#: Columns of a profile that name books.
ROLES = ("good", "bad", "wish", "avoid")


def profiles(shelf: DataFrame, feedback: DataFrame, signals: DataFrame, vectors: DataFrame, agg: DataFrame) -> DataFrame:
    """One row a user: ids of books in good, bad, wish and avoid, seen (the whole shelf), own_ids and own_vec of those outside the index, and fb_ids, fb_vec, fb_sign of feedback.

    The index is what agg(book_id) holds; vectors(book_id, vec) also holds
    books outside of it, and only their vectors travel with a user. A book that
    is nowhere counts for nothing. Feedback on a neutral rating is left out, and
    a null rating counts as liked. Signals are rows (user_id, book_id), or
    (user_id, book_ids) where they are lists already.
    """
    role = F.when(F.col("rating") == "good", "good").when(F.col("rating") == "bad", "bad").when(F.col("status") == "wishlist", "wish")
    outside = vectors.join(agg.select("book_id"), "book_id", "left_anti").select("book_id", F.col("vec").alias("own"))
    brought = F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("book_id", "own"))))
    rows = shelf.select("user_id", "book_id", role.alias("role")).where("role is not null").join(vectors.select("book_id").join(outside, "book_id", "left"), "book_id")
    by = rows.groupBy("user_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == n, F.col("book_id")))).alias(n) for n in ROLES[:3]), brought.alias("_o"))
    # Signals may be many for each user: lists stay lists, and only their books outside of the index become rows.
    lists = signals if "book_ids" in signals.columns else signals.groupBy("user_id").agg(F.collect_list("book_id").alias("book_ids"))
    lists = lists.select("user_id", F.array_sort("book_ids").alias("avoid"))
    few = outside.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS
    if few:
        every = outside.agg(F.array_sort(F.collect_list(F.struct("book_id", "own"))).alias("_all"))
        marked = lists.join(F.broadcast(every)).select("user_id", "avoid", F.filter("_all", lambda o: F.array_contains("avoid", o["book_id"])).alias("_p"))
    else:
        named = lists.select("user_id", F.explode("avoid").alias("book_id")).join(outside, "book_id").groupBy("user_id").agg(brought.alias("_p"))
        marked = lists.join(named, "user_id", "left")
    f = feedback.where("rating is null or rating <> 'neutral'").withColumn("sign", F.when(F.col("rating") == "bad", -1.0).otherwise(1.0))
    told = F.array_sort(F.collect_list(F.struct("book_id", "sign", "vec")))
    f = f.groupBy("user_id").agg(told.alias("_f")).select("user_id", F.col("_f.book_id").alias("fb_ids"), F.col("_f.vec").alias("fb_vec"), F.col("_f.sign").alias("fb_sign"))
    seen = shelf.groupBy("user_id").agg(F.collect_set("book_id").alias("seen"))
    kind = by.schema["_o"].dataType
    # The long lists come last: what a full join gives is in no order that a further join could use.
    by = seen.join(f, "user_id", "full").join(by.withColumn("_by", F.lit(True)), "user_id", "left").join(marked.withColumn("_marked", F.lit(True)), "user_id", "full").where("_by or _marked")
    both = F.concat(*(F.coalesce(c, F.expr("array()").cast(kind)) for c in ("_o", "_p")))
    ids = {c: F.coalesce(c, F.array().cast("array<bigint>")) for c in (*ROLES, "seen", "fb_ids")}
    by = by.withColumns({**ids, "fb_vec": F.coalesce("fb_vec", _none()), "fb_sign": F.coalesce("fb_sign", F.array().cast("array<double>")), "_o": both})
    return by.select("user_id", *ROLES, F.col("_o.book_id").alias("own_ids"), F.col("_o.own").alias("own_vec"), "seen", "fb_ids", "fb_vec", "fb_sign")


def _gone(users: DataFrame, taken: DataFrame | None, name: str) -> DataFrame:
    """users with an array of what is not recommended: their books in `taken`, or, without it, those of the profile's shelf.

    The profile's signals, which without `taken` are not recommended either,
    are in a column of their own and are not sent a second time (`_gone_in`).
    """
    if taken is None:
        return users.withColumn(name, F.col("seen"))
    gone = taken.groupBy("user_id").agg(F.collect_set("book_id").alias(name))
    return users.join(gone, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))


def _gone_in(taken: DataFrame | None, name: str) -> tuple[str, ...]:
    """The columns that name what is not recommended."""
    return (name,) if taken is not None else (name, "avoid")


def stage_one(users: DataFrame, items: DataFrame, agg: DataFrame, taken: DataFrame | None, n: int = CANDIDATES, w: Weights = Weights(), parts: tuple[str, ...] = ("single", "per_book"), block_bytes: int = BOOK_BYTES, carry: tuple[str, ...] = (), through: tuple[str, ...] | None = None) -> DataFrame:
    """user_id, rank, book_id, score and the item columns in `carry`: the n best items that a user has not in `taken` (None: neither on the shelf nor among the signals of the profile).

    Each part is scaled to its least and greatest value over all items,
    taken ones included; with several blocks a first pass finds these. Users
    without a resolvable good book have no rows. With `through`, columns of
    the profiles, one row a user comes out: these columns, and the books as a
    packed list `candidates`, which stage two reads without a shuffle of
    candidates.
    """
    everything = items.select("book_id", "desc", *carry).join(agg, "book_id").select("book_id", "desc", "agg", *carry)
    dims, total = everything.agg(F.max(F.size("desc")), F.count("*")).first()
    dims, everything = dims or 0, kernels.narrow(everything, "desc", "agg")
    blocks = kernels.blocks_of(everything, 16 * dims, block_bytes)
    liking = users.where(F.size("good") > 0)
    rows = _gone(kernels.packed(liking, "avoid"), taken, "taken").select("user_id", *dict.fromkeys((*ROLES, "own_ids", "own_vec", "fb_vec", "fb_sign", "taken", *(through or ()))))

    def held(t):
        t = t.sort_by("book_id")
        return kernels.ids_of(t, "book_id"), *(kernels.vectors_of(t, c, dims).astype(float, copy=False) for c in ("desc", "agg")), *(t.column(c).combine_chunks() for c in carry)

    if blocks > 1:
        rows, everything = written(rows), written(everything)
        liking = rows
    named = kernels.Named(everything, "book_id", 16 * dims + 8, liking, ROLES, held)
    if blocks > 1:
        found = kernels.meet(rows.drop("taken"), "user_id", everything, "book_id", blocks, held, lambda b: kernels.bounds_of(b, dims, w), named, NAMED_BLOCKS * block_bytes)
        rows = rows.join(found.groupBy("user_id").agg(*(f(c).alias(c) for c, f in (("lo1", F.min), ("hi1", F.max), ("lo2", F.min), ("hi2", F.max)))), "user_id")
    kept, gone = ("single" in parts, "per_book" in parts), _gone_in(taken, "taken")
    carried = {c: items.schema[c].dataType.simpleString() for c in carry}
    whole = {c: rows.schema[c].dataType.simpleString() for c in through} if through is not None and blocks == 1 else None
    out = kernels.meet(rows, "user_id", everything, "book_id", blocks, held, lambda b: kernels.best_of_block(b, dims, w, n, kept, total, blocks > 1, gone, carried, whole), named, NAMED_BLOCKS * block_bytes, ("taken",))
    # One block gives the n best of all.
    if blocks == 1:
        return out
    out = top_per(out.drop("rank"), ["user_id"], [F.desc("score"), "book_id"], n).select("user_id", "rank", "book_id", "score", *carry)
    return out if through is None else _listed(out).join(rows.select("user_id", *through), "user_id").select("user_id", *through, "candidates")


def _listed(candidates: DataFrame) -> DataFrame:
    """(user_id, candidates) with one packed list a user of candidates(user_id, book_id)."""
    lists = candidates.groupBy("user_id").agg(F.array_sort(F.collect_set("book_id")).alias("candidates"))
    return kernels.packed(lists, "candidates")


#: What the precise step reads of a profile.
PROFILE = (*ROLES, "own_ids", "own_vec", "fb_ids", "fb_vec", "fb_sign")


def _catalogue(items: DataFrame, reasons: DataFrame, vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """Books with all that the precise step reads of them, each once, the dimensions, and bytes a row.

    `told`: the book is among the vectors, so that users may name it;
    `inside`: it is an item; `apart`: an item's own vector where it is not
    that of the vectors.
    """
    dims = items.agg(F.max(F.size("desc"))).first()[0] or 0
    lists = kernels.listed(reasons, "book_id", "reason_pos").select("book_id", F.col("vecs").alias("reasons"))
    factor = F.coalesce(*(F.when(F.col("source_tier") == t, F.lit(x)) for t, x in TIER_FACTOR.items()), F.lit(1.0))
    known = vectors.groupBy("book_id").agg(F.first("vec").alias("vec"))
    rows = known.withColumn("told", F.lit(True)).join(items.select("book_id", "desc", factor.alias("factor"), F.lit(True).alias("inside")), "book_id", "full").join(lists, "book_id", "left")
    rows = rows.select(
        "book_id", F.coalesce("vec", "desc").alias("vec"), F.when(F.col("vec") != F.col("desc"), F.col("desc")).alias("apart"), F.coalesce("told", F.lit(False)).alias("told"),
        F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("factor", F.lit(1.0)).alias("factor"), "reasons",
    )
    rows = written(kernels.narrow(rows, "vec", "apart"))
    width = F.when(F.col("vec.d").isNotNull(), 8).otherwise(4) * dims + kernels.list_bytes("reasons", dims)
    return rows, dims, int(rows.agg(F.avg(width)).first()[0] or 0) + 24


def _precise(asked: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, modes: tuple[str, ...], block_bytes: int, signals: bool = True, needs: tuple[str, ...] = kernels.PARTS, **options) -> DataFrame:
    """The parts of a precise score, or what `options` of the kernel make of them, of profiles that hold candidates."""
    told, dims, row_bytes = _catalogue(items, reasons, vectors)
    # Lists that nothing reads are not sent.
    idle = [c for c in ("wish", "avoid") if (not signals or c not in needs) and c not in options.get("gone", ())]
    rows = asked.where(kernels.sizes(asked, "good", "bad") > 0).withColumns({c: F.array().cast("array<bigint>") for c in idle})
    gone = [c for c in asked.columns if c not in ("user_id", *PROFILE)]
    rows = rows.select("user_id", *PROFILE, *gone)

    def held(t):
        t = t.sort_by("book_id")
        r, first = kernels.matrices(t.column("reasons"), dims)
        vec, apart = kernels.vectors_of(t, "vec", dims), t.column("apart").combine_chunks()
        own = kernels.plain_vectors(apart).is_valid().to_numpy(zero_copy_only=False)
        if own.any():
            other, vec = kernels.vectors_of(t, "apart", dims), vec.astype(float)
            vec[own] = other
        return kernels.ids_of(t, "book_id"), vec, r, first, t.column("factor").to_numpy(), t.column("inside").to_numpy()

    def in_order(t):
        t = t.filter(t.column("told")).sort_by("book_id")
        return kernels.ids_of(t, "book_id"), kernels.vectors_of(t, "vec", dims), *kernels.matrices(t.column("reasons"), dims)

    named = kernels.Named(told, "book_id", row_bytes, rows, ROLES, in_order)
    more = {m: MODES[m] for m in modes[1:]}
    return kernels.meet(rows, "user_id", told, "book_id", kernels.blocks_of(told, row_bytes, block_bytes), held, lambda b: kernels.components_of(b, dims, modes[0], *MODES[modes[0]], signals=signals, needs=needs, more=more, **options), named, NAMED_BLOCKS * block_bytes, ("candidates",))


def _asked(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles with the candidates of each user: of rows (user_id, book_id), lists of them, or profiles that hold them already."""
    if "candidates" in candidates.columns and "good" in candidates.columns:
        return candidates
    lists = candidates if "candidates" in candidates.columns else _listed(candidates)
    return lists.join(kernels.packed(kernels.narrow(users.select("user_id", *PROFILE), "own_vec", "fb_vec"), "avoid"), "user_id")


def components(candidates: DataFrame, users: DataFrame, shelf: DataFrame, feedback: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, mode: str = "engine", block_bytes: int = BOOK_BYTES) -> DataFrame:
    """user_id, book_id and the parts of a precise score: reason, desc, bad, heard, wish, avoid.

    Only-dislike users are rated too. An item without reasons matches
    nothing (0), and its rated book still counts in the mean. `mode` says how
    a user's own words and a book's reasons mix (MODES). `users` are the
    profiles of `shelf` and `feedback`, and hold all that is needed of them.
    Candidates are rows (user_id, book_id), or what stage one gives `through`.
    """
    return _precise(_asked(candidates, users), items, reasons, vectors, (mode,), block_bytes)


def reason_modes(candidates: DataFrame, users: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, modes: tuple[str, ...], block_bytes: int = BOOK_BYTES) -> DataFrame:
    """user_id, book_id, mode, reason: the reason part of components by each mode, from one pass over the books."""
    found = _precise(_asked(candidates, users), items, reasons, vectors, modes, block_bytes, False, (), scores=lambda reason, *_: tuple(reason))
    return found.select("user_id", "book_id", F.element_at(F.array(*map(F.lit, modes)), F.col("which") + 1).alias("mode"), F.col("score").alias("reason"))


def _engine(w: Weights, signals: bool):
    """The precise score of parts and factors, and which parts it reads."""

    def score(reason, desc, bad, heard, wish, avoid, factor):
        total = w.reason * reason[0] + w.desc * desc + w.feedback * heard
        if not signals:
            return (total,)
        total = total + w.wishlist * wish - w.not_interested * avoid
        return (np.where(total > 0, total * factor, total),)

    return score, ("desc", "heard", "wish", "avoid") if signals else ("desc", "heard")


def exact_best(users: DataFrame, shelf: DataFrame, feedback: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, taken: DataFrame | None, n: int, w: Weights = Weights(), signals: bool = True, block_bytes: int = BOOK_BYTES) -> DataFrame:
    """user_id, rank, book_id, score: the n best of all items that a user has not in `taken` (None: as in stage one), by the precise score.

    Every item is rated in its block, which gives n books a user; no pair of
    user and item leaves a task otherwise.
    """
    score, needs = _engine(w, signals)
    asked = kernels.packed(kernels.narrow(_gone(users, taken, "candidates").select("user_id", *PROFILE, "candidates"), "own_vec", "fb_vec"), "avoid")
    lazy = signals and w.not_interested >= 0 and min(TIER_FACTOR.values()) >= 0
    found = _precise(asked, items, reasons, vectors, ("engine",), block_bytes, signals, needs, scores=score, n=n, gone=_gone_in(taken, "candidates"), others=True, lazy=lazy)
    return top_per(found, ["user_id"], [F.desc("score"), "book_id"], n).select("user_id", "rank", "book_id", "score")


def stage_two(candidates: DataFrame, users: DataFrame, shelf: DataFrame, feedback: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, w: Weights = Weights(), mode: str = "engine", signals: bool = True, n: int = 0, block_bytes: int = BOOK_BYTES) -> DataFrame:
    """user_id, book_id, score of candidates(user_id, book_id); without `signals` neither tiers nor wish and dislike lists count.

    The score is computed where its parts are, so that no pair is shuffled for
    it. With n only books come out that can be among a user's n best.
    """
    score, needs = _engine(w, signals)
    return _precise(_asked(candidates, users), items, reasons, vectors, (mode,), block_bytes, signals, needs, scores=score, n=n).drop("which")


def best_by_weights(candidates: DataFrame, users: DataFrame, items: DataFrame, reasons: DataFrame, vectors: DataFrame, grid: DataFrame, n: int, block_bytes: int = BOOK_BYTES) -> DataFrame:
    """name, user_id, book_id, score, rank: the n best candidates by each weighting, as weight_grid scores them."""
    # A dozen weightings.
    weightings = [tuple(r) for r in grid.select("name", "reason_w", "desc_w", "fb_w").collect()]

    def score(reason, desc, bad, heard, wish, avoid, factor):
        return tuple(a * reason[0] + b * (desc - bad) + c * heard for _, a, b, c in weightings)

    if not weightings:
        return weight_grid(components(candidates, users, None, None, items, reasons, vectors, "evaluation", block_bytes), grid).withColumn("rank", F.lit(1))
    found = _precise(_asked(candidates, users), items, reasons, vectors, ("evaluation",), block_bytes, True, ("desc", "bad", "heard"), scores=score, n=n)
    named = found.select(F.element_at(F.array(*(F.lit(x[0]) for x in weightings)), F.col("which") + 1).alias("name"), "user_id", "book_id", "score")
    return top_per(named, ["name", "user_id"], [F.desc("score"), "book_id"], n)


def near_candidates(users: DataFrame, items: DataFrame, agg: DataFrame, taken: DataFrame | None, n: int, through: tuple[str, ...] | None = None) -> DataFrame:
    """user_id, rank, book_id, score: the n items nearest to a liked book, or to a disliked one where none is liked; with `through` lists, as in stage one."""
    seeds, none = F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("bad")), F.array().cast("array<bigint>")
    # Signals do not count in this part; they only say what is not recommended.
    plain = users.select("user_id", seeds.alias("good"), *(none.alias(c) for c in ("bad", "wish")), "avoid", "seen", "own_ids", "own_vec", _none().alias("fb_vec"), F.array().cast("array<double>").alias("fb_sign"))
    silent = agg.select("book_id", F.transform("agg", lambda x: F.lit(0.0)).alias("agg"))
    return stage_one(plain, items, silent, taken, n, parts=("single",), through=through)


def weight_grid(parts: DataFrame, grid: DataFrame) -> DataFrame:
    """name, user_id, book_id, score of every weighting grid(name, reason_w, desc_w, fb_w): the evaluation form, which subtracts the nearest disliked book."""
    score = F.col("reason_w") * F.col("reason") + F.col("desc_w") * (F.col("desc") - F.col("bad")) + F.col("fb_w") * F.col("heard")
    # A dozen weightings.
    return parts.join(F.broadcast(grid)).select("name", "user_id", "book_id", score.alias("score"))


def cap_per_group(ranked: DataFrame, items: DataFrame, cap: int, n: int) -> DataFrame:
    """At most `cap` items of each first genre, then the first n, per user."""
    grouped = ranked.join(items.select("book_id", "l1"), "book_id")
    return top_per(top_per(grouped, ["user_id", "l1"], ["rank"], cap, "_in").drop("_in").withColumnRenamed("rank", "_was"), ["user_id"], ["_was"], n).drop("_was")
