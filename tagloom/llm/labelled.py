"""Bounded samples of labelled texts, and rates of characters and words in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.runtime import pin

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACE = bytes([32, *range(9, 14)])
PLAIN_MARKS = b".,"
#: All bytes but letters and those of characters beyond ASCII become a space.
LETTERS_ONLY = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def count_of(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, use: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most ``bound`` labelled documents, chosen by a hash of the id; pinned.

    Rows with a null id or label are left out; of several labels of one id the largest counts,
    of several texts the one with the smallest hash. The bound makes the ids fit for a broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if use is not None:
        usable = usable.filter(use)
    marked = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    chosen = pin(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return pin(one.select("doc_id", "label", "t.text"))
