"""Cutting texts into chunks: by fixed steps, by sentences, and by a ladder of separators.

A text's chunks are computed where the text is, with array functions; nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

#: Separators from the coarsest to the finest; below them characters.
LADDER = ["\n\n", "\n", "。", ". ", "；", "; ", "，", ", ", " "]


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _other(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def overlap_chunks(df: DataFrame, size: int = 512, overlap: int = 50, text: str = "text") -> DataFrame:
    """Rows of df a chunk, with chunk_index: `size` characters from every multiple of size - overlap, trimmed; blank ones go."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    rows = df.where(F.length(text) > 0).select(*_other(df, text), F.col(text).alias("__t"), F.posexplode(starts).alias("chunk_index", "__s"))
    rows = rows.withColumn(text, _trim(F.substring("__t", F.col("__s") + 1, F.lit(size)))).where(F.col(text) != "")
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long")).select(*_other(df, text), "chunk_index", text)


def sentence_chunks(df: DataFrame, sentences: int = 5, chars: int = 512, text: str = "text") -> DataFrame:
    """Rows of df a chunk: whole sentences, at most so many and, if more than one, so many characters."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[^。！？.!?]*[。！？.!?]|[^。！？.!?]+\z"), 0), _trim), lambda x: x != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] >= sentences) | (a["size"] + F.length(x) > chars)
        fresh = (a["n"] == 0) | full
        done = F.when(full & (a["n"] > 0), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(
            done.alias("done"), F.when(fresh, x).otherwise(F.concat_ws(" ", a["now"], x)).alias("now"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"),
            F.when(a["n"] == 0, F.length(x) + 1).when(full, F.length(x)).otherwise(a["size"] + F.length(x) + 1).alias("size"),
        )

    chunks = F.aggregate(parts, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    rows = df.select(*_other(df, text), F.posexplode(chunks).alias("chunk_index", text))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _blanks_cut(text: str) -> str:
    return text.strip(" \t\n\x0b\f\r")


def _semantic_pieces(text: str, size: int, overlap: int) -> list[str]:
    """The pieces of a text no longer than size: separators from coarse to fine, then characters with overlap; blank ones go."""
    pieces = [text]
    for k, separator in enumerate(LADDER):
        pieces = [x for p in pieces for x in (p.split(separator) if k == 0 or len(p) > size else [p]) if _blanks_cut(x)]
    by_chars = lambda p: [p[i : i + size] for i in range(0, max(len(p) - overlap, 1), size - overlap)]
    return [x for p in pieces for x in (by_chars(p) if len(p) > size else [p])]


def _merged_pieces(pieces: list[str], size: int) -> list[str]:
    """Neighbours joined by a blank while the first is under half the size or both fit."""
    done, now, n = [], [], 0
    for x in pieces:
        if now and not (n < size // 2 or n + len(x) + 1 <= size):
            done.append(_blanks_cut(" ".join(now)))
            now, n = [], 0
        n += len(x) + (1 if now else 0)
        now.append(x)
    last = _blanks_cut(" ".join(now))
    return [*done, last] if last else done


def _cut_texts(size: int, overlap: int):
    """Of an Arrow column of cleaned texts, for each a list of (text, start, end)."""

    def cut(texts):
        import pyarrow as pa

        sizes, chunks, starts, ends = [0], [], [], []
        for text in texts.to_pylist():
            at = 0
            for c in _merged_pieces(_semantic_pieces(text, size, overlap), size) if text else ():
                place = text.find(c[:50], at)
                at = place if place >= 0 else at
                chunks.append(c)
                starts.append(at)
                ends.append(at + len(c))
                at = max(at + len(c) - overlap, 0)
            sizes.append(len(chunks))
        ints = [pa.array(x, pa.int32()) for x in (starts, ends)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(chunks, pa.string()), *ints], names=["text", "start", "end"]))

    return cut


def semantic_chunks(df: DataFrame, size: int = 1024, overlap: int = 128, text: str = "text") -> DataFrame:
    """Rows of df a chunk of the cleaned text, with chunk_index, start and end.

    A chunk's start is where its first 50 characters next occur from `overlap` before the
    last chunk's end on (that very place if they don't); separators that were cut
    make later starts approximate, as they are for any reader of such chunks.
    A text is split, merged and searched in Arrow batches, in time by its length.
    """
    cut = F.arrow_udf(_cut_texts(size, overlap), "array<struct<text:string,start:int,end:int>>")
    rows = df.select(*_other(df, text), F.posexplode(cut(clean_text(F.col(text)))).alias("chunk_index", "__c"))
    return rows.select(*_other(df, text), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("__c.text").alias(text), F.col("__c.start").alias("start"), F.col("__c.end").alias("end"))
