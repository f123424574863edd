"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z in UTF-8 bytes and leaves all other bytes alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand Python at most ``rows`` texts at a time, unless the session asks for fewer.

    The default of 10,000 rows is made for numbers; that many long texts, held by two workers, would
    fill an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Ids that are sent to every executor at most; as many longs take 16 MB.
MOST_IDS_SENT = 2_000_000


def join_ids(docs: DataFrame, ids: DataFrame, name: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` on doc_id with the distinct long ids in column ``name``.

    Up to ``MOST_IDS_SENT`` counted ids go to the executors, so the texts need not move; more are
    joined by a shuffle.
    """
    ids = ids.select(F.col(name).alias("__id"))
    few = ids.limit(MOST_IDS_SENT + 1).count() <= MOST_IDS_SENT
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["__id"], how)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a missing text is empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as bytes."""
    return utf8(text).translate(LOWER).split()


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def train_labels(labels: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from.

    Rows without id or label are dropped. An id with several labels keeps the smallest.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .where(remainder(F.col("doc_id"), parts) != held_out)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
