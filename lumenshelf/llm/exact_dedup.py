"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so (within a least and a greatest
length), so equal passages give equal chunks wherever they stand. Chunk
bodies move once, to be collapsed and to verify that no two different chunks
share a digest; from then on a document is its ordered list of chunk
identifiers, and only those lists are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Of code points past Latin one in 32 or 64: a text in any script holds one every few dozen characters, and where they stand is its own.
_MARKS = "".join(f"\\x{{{c:x}}}" for c in range(0x400, 0x1000, 32)) + "".join(f"\\x{{{c:x}}}-\\x{{{c + 15:x}}}" for c in range(0x1000, 0xD800, 1024))
#: A cut follows a line end, a full stop or one of a few letters around a space, a closing mark of code, or a mark of another script.
#: These are about as far apart as a chunk is long at least, so two texts cut alike a few chunks after they begin to agree.
CUT = rf"(?s).{{64,2047}}?(?:[.!?\n]\s|\n|[aeiou][nst]\s[aeiou]|[;{{}}][^\s;{{}}]|(?=[^\x00-\x{{3ff}}])[{_MARKS}])|.{{1,2048}}"


def chunk_digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(rows: DataFrame, cut: str = CUT, digest=chunk_digest) -> DataFrame:
    """Add `recipe`, the ordered verified identifiers of the chunks of `body`, to rows of (row columns, body).

    An identifier is the chunk's digest and an ordinal that tells chunks of
    one digest apart; the ordinal is above 0 only where digests collide.
    """
    chunks = F.regexp_extract_all("body", F.lit(cut), F.lit(0))
    kept = rows.columns
    named = rows.withColumn("_chunks", chunks)
    bodies = named.select(F.explode("_chunks").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    clash = bodies.groupBy("digest").agg(F.sum("one").alias("n")).where("n > 1").select("digest")
    clash = staged(clash, "clashes")
    digests = named.select(*[c for c in kept if c != "body"], F.transform("_chunks", digest).alias("_digests"), "_chunks")
    plain = F.transform("_digests", lambda d: F.struct(d.alias("digest"), F.lit(0).alias("ordinal")))
    out = [c for c in kept if c != "body"]
    if clash.isEmpty():
        return digests.select(*out, plain.alias("recipe"))
    # Only documents that hold a clashing digest need the ordinals of their chunks.
    ranked = bodies.join(clash, "digest").select("digest", "chunk", F.expr("row_number() over (partition by digest order by chunk) - 1").cast("int").alias("ordinal"))
    placed = digests.withColumn("_row", F.monotonically_increasing_id())
    placed = staged(placed, "recipes")
    pieces = placed.select("_row", F.posexplode("_chunks").alias("pos", "chunk")).withColumn("digest", digest(F.col("chunk")))
    pieces = pieces.join(ranked, ["digest", "chunk"], "left").groupBy("_row").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "digest", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))),
            lambda p: F.struct(p["digest"].alias("digest"), p["ordinal"].alias("ordinal")),
        ).alias("recipe")
    )
    return placed.join(pieces, "_row", "left").select(*out, F.coalesce("recipe", F.array().cast("array<struct<digest:bigint,ordinal:int>>")).alias("recipe"))


def exact_duplicates(docs: DataFrame, cut: str = CUT, digest=chunk_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    docs needs doc_id and text; other columns are ignored. Texts are equal
    when their characters are; of equal texts the largest doc_id stays. Null
    counts as empty, and all empty texts form one group. Rows without doc_id
    rank below every doc_id; a group of only such rows has a null keep_id and
    keeps them all, as nothing tells them apart. Rows that repeat a doc_id
    and its text count in group_size and share one verdict. No rows give no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("text_sha256", F.sha2("body", 256))
    listed = staged(recipes(rows, cut, digest), "recipes")
    # Staged, so that the join deals both sides anew and Spark can split the rows of a large group.
    groups = staged(listed.groupBy("recipe").agg(F.max("doc_id").alias("top"), F.count("*").alias("size")).where("size > 1"), "groups")
    out = listed.join(groups, "recipe", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
