"""Columns over texts, built from Spark functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column = "text") -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def byte_size(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, also where lambdas of the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_id(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """A long that stands for an id of any type: whole numbers as they are, others by their hash; null is 0."""
    whole_number = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(doc_id).cast("long") if whole_number else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)), F.lit(0).cast("long"))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def packed(docs: DataFrame, read: tuple[str, ...]) -> DataFrame:
    """Only the columns that an operator reads, the others in one, so that none of their names can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    others = F.struct(*rest) if rest else F.lit(None).cast("struct<x:int>")
    return docs.select(*read, others.alias("__others"))


def unpacked(columns: list[str], read: tuple[str, ...]) -> list[Column]:
    """The columns that ``packed`` was given, in their order."""
    return [F.col(c) if c in read else F.col("__others")[c].alias(c) for c in columns]
