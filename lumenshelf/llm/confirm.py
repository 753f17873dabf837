"""Confirming candidates of a similarity join, word by word, without comparing all that share a bucket.

Candidates come as buckets of sets that may link. Every set is compared with
the least set of its bucket first, then with the least ones of its other
buckets unless confirmed links join them already. Only buckets that still
hold several components compare the rest, in pairs of blocks; a pair of
blocks is compared once, however many buckets it shares. So what is closed
transitively are confirmed links alone, and a group of copies costs each
member one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .filters import only_wanted
from .staging import discard, staged
from .textkernel import CHUNK_BYTES, LOWER, utf8, word_hashes, word_ids, words

#: Members compared with a leader in one task, and shingles on one side of a block.
STAR, BLOCK_SHINGLES = 256, 1 << 18
#: Times that a set takes its leader's leader for its own, so that a family is in few blocks and not in one for each leader.
JUMPS = 2


def linked(sets: list[np.ndarray], percent: int, split: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with split, only links across it count.

    Intersections of one set with all others come from one pass over an
    inverted index, so the cost follows the postings and not the pairs.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posts, where = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    start = np.concatenate([[0], np.cumsum(size)])
    root = np.arange(n)
    found = []
    for i in range(split or n):
        mine = code[start[i] : start[i + 1]]
        lo, hi = where[mine], where[mine + 1]
        total = int((hi - lo).sum())
        flat = np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
        both = np.bincount(posts[flat], minlength=n)
        hit = 100 * both >= percent * (size + size[i] - both)
        hit[: (split or i + 1)] = False
        for j in np.flatnonzero(hit):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((i, int(j)))
    return found


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as numbers, equal where and only where the words are."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    ws, we, wd = words(data, offsets)
    n = len(offsets) - 1
    if not len(ws):
        return [np.zeros(0, np.int64)] * n
    word = word_ids(data, ws, we, word_hashes(data, ws, we))
    count = np.bincount(wd, minlength=n)
    out_d, out_x, base, gram, last = [], [], 0, word, len(word)
    for size in range(1, k + 1):
        if size > 1:
            last -= 1
            if last <= 0:
                break
            _, gram = np.unique(gram[:last].astype(np.int64) * (len(word) + 1) + word[size - 1 :], return_inverse=True)
        ok = wd[:last] == wd[size - 1 :]
        if size < k:
            ok &= count[wd[:last]] == size
        at = np.flatnonzero(ok)
        out_d.append(wd[at])
        out_x.append(gram[at] + base)
        base += len(word) + 1
    d, x = np.concatenate(out_d), np.concatenate(out_x)
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    d, x = d[keep], x[keep]
    return np.split(x, np.searchsorted(d, np.arange(1, n)))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star_links(k: int, percent: int):
    """Links of each group's first row with its other rows; a few MB of text are held at a time."""

    def links(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        pairs = linked(exact_sets(pa.array(texts, pa.large_string()), k), percent, 1) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, held = None, [], [], 0
        for batch in batches:
            for lead, block, rep, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "block", "rep", "text"))):
                if (lead, block) != now:
                    yield links(ids, texts)
                    now, ids, texts, held = (lead, block), [], [], 0
                elif held > CHUNK_BYTES:
                    yield links(ids, texts)
                    ids, texts, held = ids[:1], texts[:1], 0
                ids.append(rep)
                texts.append(text)
                held += len(text)
        yield links(ids, texts)

    return run, "a long, b long"


def _block_links(k: int, percent: int):
    """Links among the rows of each pair of blocks."""

    def links(ids: list[int], sides: list[int], texts: list[str]) -> pa.RecordBatch:
        # One block is compared with itself, two only with each other.
        split = sides.count(0) % max(1, len(sides))
        pairs = linked(exact_sets(pa.array(texts, pa.large_string()), k), percent, split) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, texts = None, [], [], []
        for batch in batches:
            for *pair, side, rep, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "sub", "other_lead", "other_sub", "side", "rep", "text"))):
                if pair != now:
                    yield links(ids, sides, texts)
                    now, ids, sides, texts = pair, [], [], []
                ids.append(rep)
                sides.append(side)
                texts.append(text)
        yield links(ids, sides, texts)

    return run, "a long, b long"


def texts_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text, ...) of wanted(rep, ...) from source(doc_id, text); where a doc_id repeats, its least text."""
    found = only_wanted(source.select(F.col("doc_id").alias("rep"), "text"), wanted, "rep").join(wanted.hint("merge"), "rep")
    return found.groupBy(*wanted.columns).agg(F.min("text").alias("text"))


def _star(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links of the pairs (lead, rep)."""
    blocks = pairs.groupBy("lead").agg(F.ceil(F.count("*") / STAR).alias("blocks"))
    member = pairs.join(blocks, "lead").select("lead", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(1).alias("side"), "rep")
    leader = blocks.select("lead", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(0).alias("side"), F.col("lead").alias("rep"))
    rows = member.unionByName(leader).join(texts.hint("merge"), "rep")
    run, kind = _star_links(shingle, percent)
    rows = rows.select("lead", "block", "side", "rep", "text").repartition("lead", "block").sortWithinPartitions("lead", "block", "side", "rep")
    return rows.mapInArrow(run, kind)


def _unlike(rows: DataFrame, links: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows with the component of each column's set, and those components."""
    found = connected_components(links)
    for c in columns:
        rows = rows.join(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
    return rows, found


def _open_blocks(buckets: DataFrame, stars: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """(lead, sub, other_lead, other_sub, side, rep): the sets of each pair of blocks that still have to be compared.

    Sets are put into blocks with those that share their least leader, or
    that leader's own in turn, so that the sets of a family are together and a pair of blocks is compared
    once, however many buckets they share. Only blocks that meet in a bucket,
    and there with sets of different components, form a pair.
    """
    # What is known of a set is joined to its one row, and only then told to each of its buckets.
    home = stars.groupBy("rep").agg(F.min("lead").alias("lead"))
    for _ in range(JUMPS):
        further = home.select(F.col("rep").alias("lead"), F.col("lead").alias("next"))
        home = home.join(further, "lead", "left").select("rep", F.coalesce("next", "lead").alias("lead"))
    sets, _ = _unlike(buckets.groupBy("rep").agg(F.collect_list(F.struct("kind", "key")).alias("keys")), links, "rep")
    sets = sets.join(home, "rep", "left").withColumn("lead", F.coalesce("lead", "rep")).join(classes.select("rep", "n_shingles"), "rep")
    told = staged(sets.select(F.inline("keys"), "lead", "rep", "n_shingles", "rep_of"), "told")
    several = told.groupBy("kind", "key").agg(F.min("rep_of").alias("x"), F.max("rep_of").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("kind", "key")
    open_ = told.join(several, ["kind", "key"], "left_semi")
    sizes = open_.select("lead", "rep", "n_shingles").distinct().groupBy("lead").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("subs"))
    open_ = staged(open_.join(sizes, "lead").withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs"))).select("kind", "key", "lead", "sub", "rep", "rep_of"), "open")
    at = open_.groupBy("kind", "key", "lead", "sub").agg(F.min("rep_of").alias("low"), F.max("rep_of").alias("high"))
    other = at.select("kind", "key", F.col("lead").alias("other_lead"), F.col("sub").alias("other_sub"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    here, there = F.struct("lead", "sub"), F.struct("other_lead", "other_sub")
    apart = (F.least("low", "other_low") < F.greatest("high", "other_high")) & (here <= there)
    pairs = at.join(other, ["kind", "key"]).where(apart).select("lead", "sub", "other_lead", "other_sub").distinct()
    sets = open_.select("lead", "sub", "rep").distinct()
    first = pairs.join(sets, ["lead", "sub"]).withColumn("side", F.lit(0))
    second = pairs.where(here < there).join(sets.select(F.col("lead").alias("other_lead"), F.col("sub").alias("other_sub"), "rep"), ["other_lead", "other_sub"]).withColumn("side", F.lit(1))
    out = staged(first.unionByName(second), "blocks")
    discard(told, open_)
    return out


def confirmed_components(buckets: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the confirmed links among sets that share a bucket.

    buckets(kind, key, rep), texts(rep, text), classes(rep, n_shingles). Two
    sets link where 100 * intersection >= percent * union of their sets of
    distinct `shingle`-word shingles.
    """
    lead = buckets.groupBy("kind", "key").agg(F.min("rep").alias("lead"))
    stars = staged(buckets.join(lead, ["kind", "key"]).where("lead <> rep").select("lead", "rep").distinct(), "stars")
    links = staged(_star(stars.groupBy("rep").agg(F.min("lead").alias("lead")), texts, shingle, percent), "links")
    rest, _ = _unlike(stars, links, "lead", "rep")
    rest = staged(rest.where("lead_of <> rep_of").select("lead", "rep"), "rest")
    links = links.unionByName(staged(_star(rest, texts, shingle, percent), "links"))
    blocks = _open_blocks(buckets, stars, links, classes)
    run, kind = _block_links(shingle, percent)
    pair = ["lead", "sub", "other_lead", "other_sub"]
    dealt = blocks.join(texts.hint("merge"), "rep").select(*pair, "side", "rep", "text").repartition(*pair).sortWithinPartitions(*pair, "side", "rep")
    found = connected_components(links.unionByName(dealt.mapInArrow(run, kind)))
    discard(stars, rest, blocks)
    return found
