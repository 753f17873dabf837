"""A corpus pipeline of five operators: language, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last
one packed pieces. Stages hold for clashing extra columns, nulls and empty
tables. Where a doc_id is missing or repeats, a stage numbers the rows itself
and takes these numbers for doc_ids, so that each row is judged alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.llm import exact_dedup, langid, minhash, mixing, packing
from lumenshelf.llm.staging import staged


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column that numbers its rows, and that column's name: doc_id where it is unique and never null."""
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    id_ = F.col("doc_id").cast("long")
    if docs.groupBy(id_.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null").isEmpty():
        return docs.withColumn(name, id_), name
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; null texts, texts without a letter and texts of no likely language go."""
    return langid.drop_unidentified(docs, langid.fit_language_model(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id."""
    rows, row = _numbered(docs)
    found = staged(exact_dedup.exact_duplicates(rows.select(F.col(row).alias("doc_id"), "text")), "copies")
    return _without(rows, row, found.where("not kept").select("doc_id")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles), that with the least doc_id."""
    rows, row = _numbered(docs)
    found = staged(minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=80), "near")
    return _without(rows, row, found.where("not kept").select("doc_id")).select(docs.columns)


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    # Merged at every size: the list of dropped documents grows with the input.
    return rows.join(gone.withColumnRenamed("doc_id", row).hint("merge"), row, "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, or one to three times."""
    rows, row = _numbered(docs)
    mix = staged(mixing.mix_sources(rows.select(F.col(row).alias("doc_id"), "text", "source")), "mix").where("copies > 0")
    copies = mix.select(F.col("doc_id").alias(row), F.sequence(F.lit(1), "copies").alias(f"{row}_copies"))
    return rows.join(copies.hint("merge"), row).withColumn(f"{row}_copy", F.explode(f"{row}_copies")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack_sequences(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_to_weights),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir, staged in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"after-{name}")
    return docs


#: Copies are drawn and pieces packed by rules that SQL cannot state; tests compare with brute force.
ORACLE_SQL = None
