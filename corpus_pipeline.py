"""A corpus pipeline: documents in, reproducibly sampled piece sequences out.

Language ID, near-duplicates (five-word shingles, Jaccard 0.8), repeated passages, benchmark decontamination, pieces.
Each stage works on all that the one before kept. Rows with a null id can't be compared by
id: they pass the passage and decontamination stages untouched. Rows that share an id are told
apart by their texts in near_duplicates; passages and decontaminated take them for one document
(a leak in one drops all rows of the id). Empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_copies, op5_language_id, op6_sampling, op7_chunks, op9_decontaminate
from tidemark.llm.common import bounded_batches, crc_bucket, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: some letter, and a posterior of 0.5."""
    bounded_batches(spark)
    model = op5_language_id.fit(docs, crc_bucket(F.col("id"), 4) != 2)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    told = op5_language_id.predict(docs, model, keep=others, lang_out="__lang", score_out="__posterior")
    kept = told.filter((F.col("__lang") != op5_language_id.UNDETERMINED) & (F.col("__posterior") >= 0.5))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near copies.

    It is the row of the smallest doc_id, of the smallest text digest if that id has several
    texts there; a row without an id stays only where the component has no other. Null, empty
    and blank texts are one component.
    """
    bounded_batches(spark)
    found = near_copies.near_copies(docs.select("doc_id", "text"))
    rows = found.groupBy("comp", "doc_id", "key").agg(F.count("*").alias("copies"))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key", "copies")).alias("r"))
    firsts = materialize(first.select(F.col("r.doc_id").alias("first_id"), F.col("r.key").alias("first_key"), F.col("r.copies").alias("copies")), "firsts")
    keyed = docs.withColumn("__key", near_copies.class_key(F.col("text").cast("string")))
    same = keyed["doc_id"].cast("long").eqNullSafe(firsts["first_id"]) & (keyed["__key"] == firsts["first_key"])
    once = keyed.join(firsts.filter("copies = 1"), same, "left_semi")
    more = keyed.join(firsts.filter("copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return once.unionByName(more).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of all documents but their first; drops texts left blank.

    Texts that were null or blank before stay. A column n_chars, where there is one, is set anew.
    """
    bounded_batches(spark)
    cut = op7_chunks.remove_passages(docs.withColumn("__had_text", F.trim("text") != ""), op7_chunks.repeated_passages(docs))
    left = cut.filter(~(F.coalesce("__had_text", F.lit(False)) & (F.trim("text") == ""))).drop("__had_text")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none."""
    bounded_batches(spark)
    leaks = op9_decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, piece_digest, lossless): a sampled segmentation of every text, checked by decoding it.

    Null texts have null piece_ids, empty ones none; `op6_sampling.decode` gives the texts back.
    """
    bounded_batches(spark)
    return op6_sampling.round_trip(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("decontaminated", decontaminated), ("pieces", pieces)]

#: Hashing, sampling and models can't be expressed in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
