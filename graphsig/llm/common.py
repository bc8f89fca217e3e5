"""Column helpers shared by the training-data operators.

Row identity: ``doc_id`` may be null or repeated, so tables that are joined back to their documents
carry ``(doc_key, text_key)``: the id with nulls as one fixed key, and a 64-bit hash of the text.
Rows that agree in both are copies of one row and always get the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a Java regex class and as characters to trim.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NULL_ID = 2**63 - 1


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; all-ASCII strings take Spark's fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_key(column: str = "text") -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def fresh(table: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where the table has a column of that name (in any case)."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text) is in ``keys(__doc, __text)`` (or is not, with ``left_anti``).

    Joined on the uniform row identity, so one hot source or language never meets in one task.
    """
    doc, text = fresh(docs, "__k_doc", "__k_text")
    right = keys.select(F.col("__doc").alias(doc), F.col("__text").alias(text))
    match = (doc_key(id_col) == F.col(doc)) & (text_key(text_col) == F.col(text))
    return docs.join(right, match, how)
