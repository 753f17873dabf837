"""Mixing sources to target weights by pivotal dependent rounding.

Each document is wanted target / source_size times. Its whole copies are
certain; the fractional copy is a probability. Inside groups of one source,
from the largest document down, a coin of the document's own probability says
whether it is to be taken; then mass is transferred, pair by pair, between it
and other documents in random order until it is settled, each partner that is
drained or filled up being settled too, so words in expectation stay the
same. A group passes on a few small unsettled documents, and a tree of groups
leaves LEAVE of each source: of their choices the one whose words come
nearest to what is left is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Unsettled documents that meet in one task.
GROUP = 4096
#: Unsettled documents that a group passes on.
LEAVE = 8


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A non-null key that sorts as the source's code points do, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source_key, n_docs, source_size, target) from sizes(source_key, size).

    Weights repeat over the sources in key order and share all words; a
    target stops at `most` times its source's size and the excess is shared
    again by weight. Only the water level, one number, goes over the driver.
    """
    from .ranking import ordered_positions

    total = sizes.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = ordered_positions(total, [F.col("source_key")], "_rank", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    level = 0.0
    while words:
        full = F.col("weight") * level > cap
        capped, open_weight = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        risen = (words - capped) / open_weight if open_weight else level
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return ranked.select("source_key", "n_docs", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def _uniform(a: int, b: int, step: int) -> float:
    """A number in (0, 1) that depends on two documents and the tree's level only."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ step * 0x165667B19E3779F9) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return ((x ^ x >> 31) + 0.5) / (1 << 64)


def settle(ids: list[int], sizes: list[float], p: list[float], level: int, leave: int = LEAVE) -> list[float]:
    """Pivotal rounding of p, size-weighted, in the given order (largest first); at most `leave` values stay between 0 and 1.

    Partners come in an order that does not depend on the coin, so each
    document's own probability is kept too.
    """
    out = list(p)
    partners = sorted((i for i in range(len(p)) if 0.0 < p[i] < 1.0), key=lambda i: (_uniform(ids[i], 0, level), ids[i]), reverse=True)
    left = len(partners)
    for i in range(len(p)):
        if left <= leave:
            break
        up = _uniform(ids[i], ids[i], level) < out[i]
        while left > leave and 0.0 < out[i] < 1.0:
            while partners[-1] == i or not 0.0 < out[partners[-1]] < 1.0:
                partners.pop()
            j = partners[-1]
            wants = (1 - out[i] if up else out[i]) * sizes[i]
            has = (out[j] if up else 1 - out[j]) * sizes[j]
            sign = 1 if up else -1
            if wants <= has:
                out[i] = 1.0 if up else 0.0
                out[j] -= sign * wants / sizes[j]
            if wants >= has:
                out[j] = 0.0 if up else 1.0
                out[i] = out[i] if wants == has else out[i] + sign * has / sizes[i]
            for k in (i, j):
                out[k] = min(1.0, max(0.0, out[k]))
                left -= not 0.0 < out[k] < 1.0
    return out


def nearest(sizes: list[float], p: list[float]) -> list[float]:
    """Of the choices of the (at most LEAVE) values between 0 and 1 the one whose words come nearest to those wanted."""
    at = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    wanted = sum(p[i] * sizes[i] for i in at)
    choices = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
    best = choices[np.abs(choices @ np.array([sizes[i] for i in at], float) - wanted).argmin()] if at else []
    out = list(p)
    for i, x in zip(at, best):
        out[i] = float(x)
    return out


def _round_groups(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="grp").sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first", ignore_index=True)
        sizes = pdf["size"].astype(float).tolist()
        p = settle(pdf["order"].tolist(), sizes, pdf["part"].tolist(), level)
        pdf["part"] = np.array(nearest(sizes, p) if last else p, float)
        return pdf

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, group: int = GROUP) -> DataFrame:
    """Copies of each document that bring every source to its share of all words.

    docs needs doc_id, text and source; other columns are ignored. Returns
    doc_id, size (words), source_size, target, taken (copies * size) and
    copies (0 to `most`). Sources are weighted in code point order, null
    last; a source's taken words come as near its target as its last LEAVE,
    mostly small, documents allow. Choices depend on doc_id and size alone,
    so reruns agree. Null and blank texts have size 0 and take 0 words; their copies
    are rounded one by one. Null doc_ids and repeated rows are documents of
    their own. No rows give no rows.
    """
    group = max(group, 4 * LEAVE)
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("source_key"), word_count("text").alias("size")), "sizes")
    targets = staged(source_targets(rows, weights, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = rows.join(targets, "source_key").withColumn("wanted", wanted).withColumn("order", F.xxhash64("doc_id", "size"))
    whole = F.floor("wanted")
    coin = (F.shiftrightunsigned(F.xxhash64("order", F.lit("empty")), 11) + 0.5) / float(1 << 53)
    part = F.when(F.col("size") > 0, F.col("wanted") - whole).otherwise((coin < F.col("wanted") - whole).cast("double"))
    rows = rows.select("doc_id", "source_key", "size", "source_size", "target", "order", "n_docs", whole.cast("int").alias("whole"), part.alias("part"))
    schema, done, level = rows.schema, [], 0
    while True:
        # Level 0 knows the rows of each source; above it LEAVE documents at most came from each group.
        rows_left = F.col("n_docs") * (LEAVE / float(group)) ** level
        groups = F.greatest(F.lit(1), F.ceil(rows_left / float(group))).cast("long")
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64("order", F.lit(level)), groups))
        most_groups = targets.agg(F.max(groups)).first()[0]
        last = most_groups is None or most_groups <= 1
        settled = staged(dealt.groupBy("source_key", "grp").applyInPandas(_round_groups(level, last), schema), f"mix{level}")
        if last:
            done.append(settled)
            break
        undecided = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(settled.where(~undecided))
        rows, level = settled.where(undecided), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("part")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))
