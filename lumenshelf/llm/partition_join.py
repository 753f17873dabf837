"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Sets are put into bands by size, so that a set links only with sets of its
band and the one below. In a band all shingles are dealt by hash to m
segments; two sets that link differ by at most H shingles. Give every segment
of a set r a threshold v of -1 (ignored), 0 (equal) or 1 (at most one
deletion apart): if the v + 1 add up to H + 1, then any set within H of r
meets the threshold of some segment, because otherwise it would differ in
v + 1 shingles in each. So r needs to look only at those segments, and which
ones is a matter of cost:

1. The subset of each segment becomes a key. Keys that a set shares with
   nobody cost nothing at v = 0; with H + 1 of them a set is done.
2. For the others every `deletable`-th segment also gets its one-deletion
   neighbourhood; where nobody is within one deletion, v = 1 is free as well.
3. What is still missing is taken where the fewest sets are met.

Sets that meet are compared word by word (`confirm`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .confirm import confirmed_components, texts_of
from .filters import only_wanted
from .minhash import shingle_sets
from .staging import discard, staged
from .textkernel import U, chunks, mix, utf8

#: One spare segment for so many, which leaves a choice to the allocation; and every so many-th has a one-deletion neighbourhood.
SPARE, DELETABLE = 8, 16
#: Bits a shared key in the broadcast bitmap that thins out unshared ones, and the most of all (16 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 27


class Bands:
    """Size bands for links of at least `percent`, and how many segments and differing shingles each has."""

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        self.top = np.append(top, top[-1] * 100 // percent)
        self.most = self.differ(self.top * 100 // percent + self.top)
        self.segments = np.where(self.most > 0, self.most + 1 + (self.most + 1) // SPARE, 0)

    def differ(self, both: np.ndarray) -> np.ndarray:
        """The most shingles in which two linked sets of `both` shingles together differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def roles(self, size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """(band, segments, units needed) of sets in their own band, and in the band below, where none are needed if nothing there can link."""
        own = np.searchsorted(self.low, size, "right") - 1
        below = np.maximum(own - 1, 0)
        own_need = self.differ(2 * size) + 1
        low_need = self.differ(size + self.top[below]) + 1
        reach = (own > 0) & (self.top[below] * 100 >= size * self.percent) & (low_need > 1)
        return (own, np.where(size > 0, self.segments[own], 0), own_need), (below, np.where(reach, self.segments[below], 0), low_need)


def _segment_sums(d: np.ndarray, x: np.ndarray, band: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each shingle its slot and share; for all slots, one a document and segment, the document, segment and sum of shares."""
    has = m[d] > 0
    d, x = d[has], x[has]
    seg = (mix(x ^ mix(band[d].astype(U) + U(71))) % m[d].astype(U)).astype(np.int64)
    first = np.cumsum(m) - m
    slot, share = first[d] + seg, mix(x * U(9) + U(5))
    sums = np.zeros(int(m.sum()), U)
    np.add.at(sums, slot, share)
    doc = np.repeat(np.arange(len(m)), m)
    return slot, share, doc, np.arange(len(doc)) - first[doc], sums


def _keys(band: np.ndarray, segment: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(band.astype(U) << U(40) | segment.astype(U))).view(np.int64)


def _lists(keys: np.ndarray, m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.array(keys))


def _signatures(k: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("own", pa.list_(pa.int64())), ("below", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                d, x = shingle_sets(data[o[0] : o[-1]], o - o[0], k)
                first = np.searchsorted(d, np.arange(hi - lo + 1))
                size, sums, lists = np.diff(first), [], []
                for salt in (U(11), U(13)):
                    c = np.zeros(len(x) + 1, U)
                    np.cumsum(mix(x * U(3) + salt), out=c[1:])
                    sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
                for band, m, _ in bands.roles(size):
                    _, _, doc, segment, total = _segment_sums(d, x, band, m)
                    lists.append(_lists(_keys(band[doc], segment, total), m))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(size), *map(pa.array, sums), *lists], schema=schema)

    return run, "doc_id long, n_shingles long, set_a long, set_b long, own array<long>, below array<long>"


def _shared_keys(bitmap, percent: int):
    """A row for each key of a set that may be shared."""
    names = ["key", "rep", "segment", "own", "m", "need", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        bits = bitmap.value
        mask = U(len(bits) * 64 - 1)
        for batch in batches:
            rep, size = batch.column("rep").to_numpy(), batch.column("n_shingles").to_numpy()
            for own, column, (band, m, need) in zip((True, False), ("own", "below"), bands.roles(size)):
                keys = batch.column(column).flatten().to_numpy()
                at = keys.view(U) & mask
                hit = np.flatnonzero(bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1))
                doc = np.repeat(np.arange(len(rep)), m)
                segment = np.arange(len(doc)) - (np.cumsum(m) - m)[doc]
                of = doc[hit]
                columns = [keys[hit], rep[of], segment[hit], np.full(len(hit), own), m[of], need[of], m[of] - bands.most[band[of]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run, "key long, rep long, segment long, own boolean, m long, need long, least long"


def _neighbourhoods(k: int, percent: int):
    """Keys of the deletable segments, whole and with one shingle deleted."""
    names = ["key", "rep", "segment", "own", "whole", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                rep = batch.column("rep").to_numpy()[lo:hi]
                d, x = shingle_sets(data[o[0] : o[-1]], o - o[0], k)
                size = np.bincount(d, minlength=hi - lo)
                for own, flag, (band, m, _) in zip((True, False), ("probe_own", "probe_below"), bands.roles(size)):
                    probe = batch.column(flag).to_numpy(zero_copy_only=False)[lo:hi]
                    m = m if own else np.where(probe, m, 0)
                    slot, share, doc, segment, total = _segment_sums(d, x, band, m)
                    whole = np.flatnonzero(segment % DELETABLE == 0)
                    less = np.flatnonzero(segment[slot] % DELETABLE == 0)
                    at = np.concatenate([whole, slot[less]])
                    sums = np.concatenate([total[whole], total[slot[less]] - share[less]])
                    of = doc[at]
                    columns = [_keys(band[of], segment[at], sums), rep[of], segment[at], np.full(len(at), own), np.arange(len(at)) < len(whole), probe[of]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run, "key long, rep long, segment long, own boolean, whole boolean, probe boolean"


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of the low bits of the keys; 16 bits a key, MOST_BITS at most."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (keys.count() * BITS_PER_KEY - 1).bit_length()))
    at = F.expr(f"key & {bits - 1}L")
    found = keys.select(at.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, U)
    bitmap[found["w"].to_numpy()] = found["b"].to_numpy().view(U)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def _buckets(entries: DataFrame, source: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(kind, key, rep): sets that may link, by the key that they meet in; and (rep, text, n_shingles) of all that occur there."""
    # 1. Keys that sets share, and what it costs to look at them.
    each = entries.select(F.explode("own").alias("key"), F.lit(1).alias("i")).unionByName(entries.select(F.explode("below").alias("key"), F.lit(0).alias("i")))
    shared = staged(each.groupBy("key").agg(F.sum("i").alias("n_own"), F.count("*").alias("n")).where("n_own > 0 and n > 1").select("key", "n_own"), "shared-keys")
    run, kind = _shared_keys(_bitmap(shared), percent)
    hits = staged(entries.mapInArrow(run, kind).join(shared.hint("merge"), "key").withColumn("cost", F.col("n_own") - F.col("own").cast("long")).drop("n_own"), "shared")
    of = hits.groupBy("rep", "own").agg(F.count("*").alias("all"), F.sum((F.col("cost") > 0).cast("long")).alias("costly"), F.max("m").alias("m"), F.max("need").alias("need"), F.max("least").alias("least"))
    short = F.col("need") - F.col("m") + F.col("costly")
    probes = staged(of.where((short > 0) & (F.col("need") > 1)).select("rep", "own", short.alias("short"), "m"), "probes")
    partners = of.where("own and all >= least").select("rep", F.lit(False).alias("p"), F.lit(True).alias("own"))
    needed = partners.unionByName(probes.select("rep", F.lit(True).alias("p"), "own")).groupBy("rep").agg(F.max(F.expr("p and own")).alias("probe_own"), F.max(F.expr("p and not own")).alias("probe_below"))
    needed = staged(needed, "needed")
    texts = staged(texts_of(source, needed), "texts")

    # 2. One-deletion neighbourhoods, and whom a probe meets at v = 1.
    run, kind = _neighbourhoods(shingle, percent)
    around = staged(texts.mapInArrow(run, kind), "neighbourhoods")
    met = around.groupBy("key").agg(F.sum(F.expr("int(own and whole)")).alias("wholes"), F.sum(F.expr("int(own and not whole)")).alias("parts"), F.count("*").alias("n"), F.max("probe").alias("p"))
    met = staged(met.where("n > 1 and p and wholes + parts > 0").drop("n", "p"), "met")
    around = staged(only_wanted(around, met, "key").join(met.hint("merge"), "key"), "around")
    cost = F.when(F.col("whole"), F.col("wholes") - F.col("own").cast("long") + F.col("parts")).otherwise(F.col("wholes"))
    looked = around.where("probe").withColumn("cost", cost).where("cost > 0")
    nearby = looked.groupBy("rep", "own", "segment").agg(F.sum("cost").alias("near"))

    # 3. The cheapest units that are still missing.
    first = hits.where("cost > 0").select("rep", "own", "segment", F.lit(1).alias("unit"), "cost", "key")
    second = nearby.join(hits.where("cost > 0").select("rep", "own", "segment", "cost"), ["rep", "own", "segment"], "left").select(
        "rep", "own", "segment", F.lit(2).alias("unit"), F.greatest(F.coalesce("cost", F.lit(0)), F.col("near") - F.coalesce("cost", F.lit(0))).alias("cost"), F.lit(None).cast("long").alias("key")
    )
    free = F.ceil(F.col("m") / DELETABLE)
    missing = probes.join(nearby.groupBy("rep", "own").agg(F.count("*").alias("taken")), ["rep", "own"], "left").select("rep", "own", (F.col("short") - free + F.coalesce("taken", F.lit(0))).alias("missing"))
    units = first.unionByName(second).join(missing.where("missing > 0"), ["rep", "own"])
    cheapest = F.row_number().over(Window.partitionBy("rep", "own").orderBy("cost", "unit", "segment"))
    taken = staged(units.withColumn("at", cheapest).where("at <= missing").select("rep", "own", "segment", "unit", "key"), "taken")
    equal = taken.where("unit = 1").select(F.lit(0).alias("kind"), "key", "rep")
    apart = looked.join(taken.where("unit = 2").select("rep", "own", "segment"), ["rep", "own", "segment"], "left_semi")
    asked = equal.unionByName(apart.where("wholes > 0").select(F.lit(0).alias("kind"), "key", "rep")).unionByName(apart.where("whole and parts > 0").select(F.lit(1).alias("kind"), "key", "rep"))
    held = (
        hits.where("own").select(F.lit(0).alias("kind"), "key", "rep")
        .unionByName(around.where("own").select(F.when(F.col("whole"), 0).otherwise(1).alias("kind"), "key", "rep"))
        .join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    )
    # A set without its text here is no partner of any probe.
    found = asked.unionByName(held).distinct().join(texts.select("rep"), "rep", "left_semi")
    found = staged(found.select("kind", "key", "rep"), "buckets")
    discard(shared, hits, probes, needed, met, around, taken)
    return found, staged(texts.select("rep", "text"), "candidates")


def similar_sets(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Components of documents whose shingle sets are alike, exactly: doc_id, n_shingles, component_id.

    docs needs doc_id and text; other columns are ignored. Two documents link
    where 100 * intersection >= percent * union of their sets of distinct
    `shingle`-word shingles (A-Z lower-cased; a shorter text is one shingle).
    component_id is the least doc_id reachable by links. No link is lost: the
    partition only decides where sets meet, and all that meet are compared by
    their words, unless confirmed links join them already. Sets of 128 bits
    of equal digest and equal size count as the same set.

    Null, empty and blank texts have no shingles and are linked with
    nothing, as are rows without doc_id (their component_id is null). Rows
    that repeat a doc_id with different texts should not occur: the doc_id
    then stands for one of them in links. No rows give no rows.

    Each document writes about 0.35 keys a shingle. A group of sets that
    share a key is never gathered: its members meet its least set in tasks of
    `STAR` members; where they are of different components still, they meet in
    pairs of blocks of about `BLOCK_SHINGLES` shingles.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, kind = _signatures(shingle, percent)
    key = ["n_shingles", "set_a", "set_b"]
    signed = staged(source.mapInArrow(run, kind), "signed")
    plain = staged(signed.select("doc_id", *key), "sets")
    classes = staged(plain.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    entries = signed.where("size(own) + size(below) > 0").withColumnRenamed("doc_id", "rep").join(classes.hint("merge"), ["rep", *key], "left_semi")
    entries = staged(entries.select("rep", "n_shingles", "own", "below"), "entries")
    discard(signed)
    buckets, texts = _buckets(entries, source, shingle, percent)

    found = confirmed_components(buckets, texts, classes.select("rep", "n_shingles"), shingle, percent).withColumnRenamed("node", "rep")
    label = classes.join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    discard(entries, buckets, texts)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return plain.join(label, key, "left").select("doc_id", "n_shingles", component.alias("component_id"))
