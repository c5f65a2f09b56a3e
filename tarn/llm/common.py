"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.state import attach, packed, remove, settled, shared_folder, ship

__all__ = ["SPACES", "WORD", "attach", "documents", "id_remainder", "packed", "remove", "settled", "shared_folder", "ship", "words"]
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
