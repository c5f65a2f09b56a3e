"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, source weights, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. Every stage is written as Parquet and read again by the next. All stages pass an empty table on, and
other columns of the documents may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import chunks, mixing, pieces, quality, shingles
from tarn.llm.common import WORD, remove, shared_folder

#: Near-duplicates: shingles of five words.
SHINGLE = 5


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumns({"text": text, "n_chars": F.length(text).cast("long")}) if "n_chars" in docs.columns else docs.withColumn("text", text)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that the rules reject go.

    Null and empty texts are rejected, very long ones are judged whole, repeated rows alike; a null id changes nothing.
    """
    kept = quality.clean_lines(docs, carry=True).where("kept")
    # The new text goes into the struct, so no name of the engine's meets one of the document's.
    doc = F.col("doc").withField("text", F.col("cleaned"))
    doc = doc.withField("n_chars", F.length("cleaned").cast("long")) if "n_chars" in docs.columns else doc
    return kept.select(doc.alias("doc")).select("doc.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a shingle similarity of 0.8 or more one document stays, that of smallest id (null last).

    Fingerprints and pivots pick the pairs, whole shingle sets verify them. Documents are told apart by id and text:
    an id with several texts loses only those that go, and of equal rows one stays. Null texts count as empty; a very
    long text is held whole by the task that reads it.
    """
    return shingles.one_of_each(docs, SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first; a document that loses its last word goes.

    The first is that of smallest id; rows of one id keep theirs together, rows without one lose nothing. Null and
    empty texts stay as they are, and other columns may have any name.
    """
    out = chunks.dedup(docs)
    found = out.columns[-1]  # its name depends on those of docs
    return _with_text(out.where((F.col(f"`{found}`.n_removed") == 0) | F.col("text").rlike(WORD)), F.col("text")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words have size 0 and are taken at their source's rate; a null source is a source of its own; rows
    equal in id and text are taken one by one.
    """
    mixed = mixing.mix(docs, carry=True).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*").select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text; null and empty texts have no ids, a null id stays."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: SQL can't express the rolling hash, the fingerprints or the pieces; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's table is in the shared folder until the next one is written;
    the last one stays, as the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
