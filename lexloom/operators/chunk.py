"""Chunking of texts into windows and into packed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

CHUNK = "array<struct<text:string,start:int,end:int,overlap:int>>"


def sizes(size: int | None, overlap: int | None) -> tuple[int, int, int]:
    size = max(16, size or 512)
    overlap = max(0, min(size - 1, overlap or 0))
    return size, overlap, max(1, size - overlap)


def windows(text: Column, base: Column, size: int, overlap: int) -> Column:
    """Windows of a text that begins at `base`: an array of (text, start, end, overlap), empty for an empty text."""
    size, overlap, step = sizes(size, overlap)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            F.substr(text, k * step + 1, F.lit(size)).alias("text"), (base + k * step).cast("int").alias("start"), (base + F.least(k * step + size, n)).cast("int").alias("end"), F.when(k == 0, 0).otherwise(overlap).cast("int").alias("overlap")
        ),
    )
    return F.when(n == 0, F.array().cast(CHUNK)).otherwise(made)


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_id, text, start, end, overlap of fixed windows; a null or empty text has none."""
    made = windows(F.coalesce("text", F.lit("")), F.lit(0), size, overlap)
    return docs.select("doc_id", F.posexplode(made).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.*")


def packed_chunks(docs: DataFrame, separator: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """Greedy packing of separated segments; segments over `size` become windows. An ordered fold inside each row, no shuffle."""
    if not separator:
        return fixed_chunks(docs, size, overlap)
    size, overlap, _ = sizes(size, overlap)
    gap = len(separator)
    none = F.array().cast(CHUNK)
    start = F.struct(none.alias("out"), F.lit("").alias("cur"), F.lit(0).alias("at"), F.lit(0).alias("cursor"))

    def flushed(acc: Column) -> Column:
        one = F.struct(acc["cur"].alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(acc["cur"])).alias("end"), F.lit(0).alias("overlap"))
        return F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(one)))

    def step(acc: Column, seg: Column) -> Column:
        n, cur, after = F.length(seg), acc["cur"], acc["cursor"] + F.length(seg) + gap
        large = F.struct(F.concat(flushed(acc), windows(seg, acc["cursor"], size, overlap)).alias("out"), F.lit("").alias("cur"), after.alias("at"), after.alias("cursor"))
        joint = F.when(cur == "", seg).otherwise(F.concat(F.lit(separator), seg))
        # the space test adds the joint to the buffer as it stands
        fits = (F.length(cur) + F.length(joint) <= size) | (cur == "")
        pack = F.struct(acc["out"].alias("out"), F.concat(cur, joint).alias("cur"), acc["at"].alias("at"), after.alias("cursor"))
        tail = F.right(cur, F.lit(overlap)) if overlap else F.lit("")
        fresh = F.struct(flushed(acc).alias("out"), F.concat(tail, F.when(tail == "", F.lit("")).otherwise(F.lit(separator)), seg).alias("cur"), (acc["cursor"] - F.length(tail)).alias("at"), after.alias("cursor"))
        return F.when(n > size, large).when(fits, pack).otherwise(fresh)

    segments = F.split(F.coalesce("text", F.lit("")), "\\Q" + separator + "\\E")
    made = bind(segments, lambda s: F.aggregate(s, start, step, flushed))
    return docs.select("doc_id", F.posexplode(made).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.*")
