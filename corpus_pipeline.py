"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last the places of pieces in sequences. Stages work on whatever rows
they are given: null or empty texts, repeated rows and empty tables included. Columns
past those of documents are carried along, whatever their names.
doc_id names a document: rows that share one stay or go together in stage 2, but of
rows with the same doc_id and text it keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklattice.llm import language_crf, minhash, mixing, packing, storage, substring_dedup

#: A text whose words' own best labels get a smaller mean posterior is in no language known here.
LEAST_CERTAINTY = 0.4
_WHITE = r"^[\x20\x09-\x0D]*$"
_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns that are not documents' own renamed, so that none is named like one that an operator adds."""
    return docs.toDF(*(c if c in _OWN else f"_extra{i}" for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose words are labelled with less than LEAST_CERTAINTY on average (a text of
    several known languages stays); the column lang stays as it is."""
    columns, docs = docs.columns, _plain(docs)
    model = language_crf.fit(docs)
    if not model.labels:
        return docs.toDF(*columns)  # nothing to learn from: nothing is rejected
    found = language_crf.identify(docs, model, *docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY)).select(*docs.columns).toDF(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked at similarity 0.8 of five-word shingles; of rows with
    equal doc_id and text the one whose other own columns are smallest."""
    columns, docs = docs.columns, _plain(docs)
    kept = minhash.near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    names = docs.columns
    docs = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    docs = docs.withColumn("_same", F.xxhash64(F.col("text").isNull(), "text"))
    one = Window.partitionBy("doc_id", "_same").orderBy(*(c for c in _OWN[2:] if c in names), F.lit(0))
    return docs.withColumn("_row", F.row_number().over(one)).where("_row = 1").select(*names).toDF(*columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of 100-byte strings that also start earlier; n_chars follows. Bytes of a character cut in two go too. A
    document of which only white space is left goes."""
    columns, docs = docs.columns, _plain(docs)
    out = substring_dedup.deduplicated(docs, docs.columns)
    cut = F.size("begins") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).where(~cut | ~F.coalesce(F.col("text"), F.lit("")).rlike(_WHITE))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns).toDF(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the sources' target weights."""
    return mixing.mixed_documents(_plain(docs)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents: a row for each piece with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("pack", pack)]

#: SQL can express neither the language model nor signatures, so there is none; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return docs
