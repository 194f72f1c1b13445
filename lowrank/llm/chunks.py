"""Substring deduplication by content-defined chunks (operator 1).

A gear hash rolls over the bytes of a text; a chunk ends after a white-space
byte where the hash is below a threshold, one in ``WORDS_PER_CHUNK`` of them, or
(rarely) at any code point, so that texts without spaces are cut too.  The
hash sees 16 bytes only, so cuts depend on the text around them alone and find
their places again after an insertion.  A chunk whose digest occurs in several
documents belongs to the one with the smallest id; elsewhere it is a repeat.
Runs of consecutive repeats of ``MIN_WORDS`` words or more are removed; shorter
ones (common phrases, a license line) stay.

Digests are grouped with partial aggregation (smallest and largest document),
joined back to their places, and the repeats of each document are collected (at
most its own chunks).  A digest that very many documents share is one row after
grouping and one AQE-split join key.

A document is an id with its text.  Where an id has one text, the id itself names
and orders the document; texts that share an id (null included) are named by a
hash of id and text and come before all others.  Which ids these are is
found from ids and hashes alone; few of them are broadcast, many are joined.

Defined cases: null text is empty; a text shorter than a chunk is one chunk; a
document whose whole text repeats becomes empty; rows repeated with one
doc_id and text are one document (none removes the other); different texts of one
id are different documents; a null id that has one text is the smallest; an empty
table gives an empty result; further columns are kept by ``remove_repeats``,
whatever their names, but for one called as the spans it adds, which these replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.llm.common import Powers, by_value, free_name, mix64, read_table, save_table, span_hashes, text_blocks, text_bytes, word_spans

by_value(__name__)

WORDS_PER_CHUNK, MIN_WORDS = 5, 16
_RARE = 16                              # of 65536: cuts at any code point
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
_WINDOW = 16
_LOWEST = -(1 << 63)
BROADCAST_IDS = 200_000                 # ids of several texts up to this count may be broadcast (2 MB)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash h[i] = 2 h[i-1] + G[byte i] modulo 2^16, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint16(k)
        h = wider
    return h


def chunk(arr: pa.LargeStringArray, powers: Powers, words_per_chunk: int = WORDS_PER_CHUNK):
    """(text number, start, end, digest) of all chunks of a block of texts;
    byte places within the text."""
    data, offs = text_bytes(arr)
    h = gear(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    whole = np.ones(len(data), bool)             # the next byte starts a code point
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    cut = (blank & (h < 65536 // words_per_chunk)) | (whole & (h < _RARE))
    at = np.flatnonzero(cut) + 1
    doc = np.searchsorted(offs, at - 1, "right") - 1
    # Near its start a text's hash would see the text before it.
    at = at[at - offs[doc] >= _WINDOW]
    edges = np.unique(np.concatenate([at, offs]))
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(offs, start, "right") - 1
    return doc, start - offs[doc], end - offs[doc], span_hashes(data, start, end, powers).view(np.int64)


def _named(docs: DataFrame, shared: str, place: str) -> DataFrame:
    """``docs`` with the name of each row's document: whether other texts
    share its id, and the id, or then a hash of id and text."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    own = F.xxhash64(id_, F.coalesce(F.col("text").cast("string"), F.lit("")))
    several = (docs.select(id_.alias("id"), own.alias("own")).groupBy("id").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
               .where("lo < hi").select(F.col("id").alias(place)))
    several = save_table(several, "several")
    n = several.count()
    rows = docs.withColumn(place, id_)
    if not n:
        return rows.withColumn(shared, F.lit(False))
    # A checked count decides: few ids are broadcast, many are joined by shuffle.
    several = several.withColumn(shared, F.lit(True))
    rows = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, place, "left")
    return rows.withColumns({shared: F.coalesce(F.col(shared), F.lit(False)), place: F.when(F.col(shared), own).otherwise(F.col(place))})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for rows, texts in text_blocks(batches, "text"):
        doc, start, _, digest = chunk(texts, powers)
        doc = pa.array(doc)
        yield pa.RecordBatch.from_arrays([pa.array(digest), rows.column("shared").take(doc), rows.column("place").take(doc), pa.array(start.astype(np.int32))],
                                         names=["digest", "shared", "place", "start"])


def repeats(docs: DataFrame) -> DataFrame:
    """(shared, place, chunks): per document the (start, digest) of chunks that
    an earlier document holds too, from rows (shared, place, text)."""
    places = docs.mapInArrow(_places, "digest long, shared boolean, place long, start int")
    # Documents of shared ids come first, then the others: two smallest and two largest places, all plain longs.
    ends = places.groupBy("digest").agg(*[f(F.when(F.col("shared") == s, F.col("place"))).alias(f"{n}{int(s)}")
                                          for s in (False, True) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    several = (F.col("lo1").isNotNull() & F.col("lo0").isNotNull()) | (F.col("lo0") < F.col("hi0")) | (F.col("lo1") < F.col("hi1"))
    # Stored, so both sides of the join are plain shuffles, which AQE splits at a digest that very many places share.
    held = save_table(ends.where(several).select("digest", F.col("lo1").isNotNull().alias("first_shared"), F.coalesce("lo1", "lo0").alias("first")), "shared")
    again = places.join(held, "digest").where((F.col("shared") != F.col("first_shared")) | (F.col("place") != F.col("first")))
    return again.groupBy("shared", "place").agg(F.collect_list(F.struct("start", "digest")).alias("chunks"))


def _apply(min_words: int, names: list[str], chunks: str, spans_as: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, texts in text_blocks(batches, "text"):
            doc, start, end, digest = chunk(texts, powers)
            data, offs = text_bytes(texts)
            ws, _, _ = word_spans(data, offs)
            lists = rows.column(chunks).to_pylist()
            known = {(i, c["start"], c["digest"]) for i, x in enumerate(lists) if x for c in x}
            hit = np.array([k in known for k in zip(doc.tolist(), start.tolist(), digest.tolist())], bool) if known else np.zeros(len(doc), bool)
            # Runs of consecutive repeats within a text.
            same = np.concatenate([[False], (doc[1:] == doc[:-1]) & hit[1:] & hit[:-1]])
            first = np.flatnonzero(hit & ~same)
            last = np.flatnonzero(hit & ~np.concatenate([same[1:], [False]]))
            a, b = start[first] + offs[doc[first]], end[last] + offs[doc[first]]
            long = np.searchsorted(ws, b) - np.searchsorted(ws, a) >= min_words
            cuts: dict[int, list] = {}
            for d, i, j in zip(doc[first][long].tolist(), start[first][long].tolist(), end[last][long].tolist()):
                cuts.setdefault(d, []).append((i, j))
            out, spans = texts.to_pylist(), [[] for _ in range(len(texts))]
            for d, runs in cuts.items():
                raw, kept, at, chars = out[d].encode(), [], 0, 0
                for i, j in runs:
                    kept.append(raw[at:i])
                    chars += len(raw[at:i].decode())
                    n = len(raw[i:j].decode())
                    spans[d].append({"start": chars, "end": chars + n})
                    chars, at = chars + n, j
                out[d] = b"".join([*kept, raw[at:]]).decode()
            # Texts that lose nothing stay as they were, null included.
            old = rows.column("text").to_pylist()
            cols = {n: rows.column(n) for n in names}
            cols["text"] = pa.array([o if i in cuts else t for i, (o, t) in enumerate(zip(out, old))], pa.string())
            if spans_as:
                cols[spans_as] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, spans_as: str | None = "removed") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and their (start,
    end) in code points of the old text as ``spans_as`` (None: left out).
    Needs doc_id and text."""
    if spans_as:
        docs = docs.drop(spans_as)
    shared, place, chunks = (free_name(docs, n) for n in ("shared", "place", "chunks"))
    named = _named(docs, shared, place)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = save_table(repeats(named.select(F.col(f"`{shared}`").alias("shared"), F.col(f"`{place}`").alias("place"), text)), "repeats")
    found = found.select(F.col("shared").alias(shared), F.col("place").alias(place), F.col("chunks").alias(chunks))
    joined = named.join(found, [shared, place], "left").select(*[F.col(f"`{n}`") for n in [*docs.columns, chunks]])
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    schema = T.StructType(fields + ([T.StructField(spans_as, SPANS)] if spans_as else []))
    return joined.mapInArrow(_apply(min_words, docs.columns, chunks, spans_as), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    width = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), width.alias("n_removed"), spans.alias("removed"))
