"""The fold of a document: crc32 of its id as text, modulo 5; fold 0 is held out."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is held out (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0
