"""Byte-level BPE over a whole corpus (operator 8).

Encoding is a join on distinct words.  Each task cuts its texts into chunks
of a bounded number of bytes and pre-tokenizes them; a chunk yields its
distinct words, and for its documents the numbers of their words in order (the
positions).  The words are shuffled by a hash of the word; each distinct word
of the corpus is merged once there and its ids go back to the chunks that hold
it; a cogroup by chunk puts the ids in the order of the positions.  Words, ids
and positions travel packed: a frequent word counts once per chunk, and texts
are never shuffled.  The two sides read the table separately; a chunk is named by a digest of
its whole documents, and one that is not the same on both sides is an error.
The buckets grow with the corpus, so what a task remembers of one bucket does not.

Decoding joins ids with the token-byte table (the vocabulary, of fixed
size) on the map side and concatenates the bytes.

Defined cases: null text is empty; an empty text has no ids; rows repeated
with one doc_id are encoded each; ids without a token are an error; a text
longer than a chunk is a chunk of its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.llm.common import Numbers, by_value, read_table, shuffle_partitions, text_blocks
from lowrank.llm.segments import Memo, pieces

by_value(__name__)

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20            # text bytes per bucket of words


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=4 * n), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def _word_list(words, buckets: int) -> list[list[str]]:
    """The distinct words of a chunk by bucket, each bucket sorted: a word's
    number is its place in this order, on both sides of the join."""
    out = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w.encode()) % buckets].append(w)
    for x in out:
        x.sort()
    return out


def _digest(rows, texts: list[str]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for d, t in zip(rows.column("doc_id").to_pylist(), texts):
        raw = t.encode("utf-8", "surrogatepass")
        h.update(f"{d}:{len(raw)};".encode())
        h.update(raw)
    return int.from_bytes(h.digest(), "little", signed=True)


def _matches(find, lead: str, segment: str) -> list[str]:
    """Pre-tokens of a segment; letters alone are one, with or without their space."""
    return [lead + segment] if segment.isalpha() else find(lead + segment)


def _chunk_words(texts: list[str], find) -> set[str]:
    plain, spaced = set(), set()
    for t in texts:
        head, tail = pieces(t)
        plain.update(head)
        spaced.update(tail)
    words = set()
    for lead, group in (("", plain), (" ", spaced)):
        for x in group:
            words.update(_matches(find, lead, x))
    return words


def _chunk_tokens(texts: list[str], find) -> tuple[Numbers, np.ndarray, list[int]]:
    """(words in order of first use, number of the word of each token, tokens
    of each text); segments are cut once per chunk."""
    segments, parts = Numbers(), []
    for t in texts:
        head, tail = pieces(t)
        parts.append(np.array([segments[h,] for h in head] + list(map(segments.__getitem__, tail)), np.int64))
    flat, sizes = [], []
    for x in segments:
        found = _matches(find, "", x[0]) if isinstance(x, tuple) else _matches(find, " ", x)
        flat += found
        sizes.append(len(found))
    words = Numbers()
    values = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    tokens, end = _gather(values, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate(parts))
    cut = end[np.concatenate([[0], np.cumsum([len(x) for x in parts])])]
    return words, tokens, np.diff(cut).tolist()


def _words(pattern: str, chunk_bytes: int, buckets: int):
    """One row per chunk and bucket: its sorted words, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        find, press = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=1)
        for rows, texts in text_blocks(batches, "text", chunk_bytes):
            texts = texts.to_pylist()
            out = [[], [], [], []]
            for i, ws in enumerate(_word_list(_chunk_words(texts, find), buckets)):
                raw = [w.encode() for w in ws]
                for col, x in zip(out, (i, len(raw), _pack(np.array([len(r) for r in raw], np.int64)), press.compress(b"".join(raw)))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(buckets, _digest(rows, texts))), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["chunk", "bucket", "n", "sizes", "words"])
    return run


def _positions(pattern: str, chunk_bytes: int, buckets: int):
    """One row per chunk: its documents, and the numbers of their words in
    text order, packed with the smallest codes for the most frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for rows, texts in text_blocks(batches, "text", chunk_bytes):
            texts = texts.to_pylist()
            met, flat, sizes = _chunk_tokens(texts, find)
            number = np.empty(len(met), np.int64)
            number[[met[w] for x in _word_list(met, buckets) for w in x]] = np.arange(len(met))
            order = np.argsort(-np.bincount(flat, minlength=len(met)), kind="stable")
            code = np.empty(len(met), np.int64)
            code[order] = np.arange(len(met))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(rows, texts)]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(number[order])], pa.binary()),
                 pa.array([_pack(code[flat])], pa.binary()), pa.array([len(met)], pa.int32())],
                names=["chunk", "docs", "sizes", "ranked", "packed", "n_words"])
    return run


def _merge_words(table):
    """Ids of the words of each chunk and bucket; rows come sorted by bucket,
    and each distinct word of a bucket is merged once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        enc = tiktoken.Encoding("corpus", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})
        merge, wide = enc._core_bpe.encode_single_piece, zstandard.ZstdDecompressor()
        memo, bucket = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    bucket, memo = row["bucket"], Memo(lambda w: np.array(merge(w), "<u4").tobytes(), b"")
                end = np.cumsum(_unpack(row["sizes"], row["n"]), dtype=np.int64)
                raw = wide.decompress(row["words"], max_output_size=max(1, int(end[-1]) if len(end) else 1))
                ids = [memo[raw[i:j]] for i, j in zip([0, *end[:-1]], end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]]), pa.array([bucket], pa.int32()), pa.array([row["n"]], pa.int32()),
                     pa.array([_pack(np.array([len(x) // 4 for x in ids], np.int64))], pa.binary()),
                     pa.array([_pack(np.frombuffer(b"".join(ids), "<u4"))], pa.binary())],
                    names=["chunk", "bucket", "n", "sizes", "ids"])
    return run


def _gather(values: np.ndarray, offs: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ``values[offs[i]:offs[i+1]]`` for i in pick, and its offsets."""
    n = np.diff(offs)[pick]
    end = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(end[-1]) + np.repeat(offs[:-1][pick] - end[:-1], n)], end


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """Ids of the documents of one chunk from its words' ids and positions.
    Chunks that are equal as a whole share their words."""
    by_bucket: dict[int, dict] = {}
    for r in right.to_pylist():
        if by_bucket.setdefault(r["bucket"], r) != r:
            raise ValueError("a chunk arrived with two lists of words")
    parts = [by_bucket[i] for i in sorted(by_bucket)]
    n_words = sum(p["n"] for p in parts)
    if set(left.column("n_words").to_pylist()) != {n_words}:
        raise ValueError("a chunk differs between the two readings of the table")
    sizes = [_unpack(p["sizes"], p["n"]) for p in parts]
    values = np.concatenate([np.zeros(0, np.uint32), *(_unpack(p["ids"], int(s.sum())) for p, s in zip(parts, sizes))])
    offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    docs, ids, lengths = [], [], []
    for row in left.to_pylist():
        count = np.asarray(row["sizes"], np.int64)
        pick = _unpack(row["ranked"], n_words)[_unpack(row["packed"], int(count.sum()))].astype(np.int64)
        flat, end = _gather(values, offs, pick)
        cut = end[np.concatenate([[0], np.cumsum(count)])]
        docs.extend(row["docs"])
        lengths.extend(np.diff(cut).tolist())
        ids.extend(flat[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:]))
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array(ids, pa.binary())})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.
    ``buckets`` is the number of groups of words, by default one for every
    BUCKET_BYTES of text, at least as many as shuffle partitions; a task holds
    the distinct words of one bucket."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    words = rows.mapInArrow(_words(pattern, chunk_bytes, buckets), "chunk long, bucket int, n int, sizes binary, words binary")
    ids = (words.repartition("bucket").sortWithinPartitions("bucket")
           .mapInArrow(_merge_words(table), "chunk long, bucket int, n int, sizes binary, ids binary"))
    places = rows.mapInArrow(_positions(pattern, chunk_bytes, buckets),
                             "chunk long, docs array<long>, sizes array<int>, ranked binary, packed binary, n_words int")
    return (places.groupBy("chunk").cogroup(ids.groupBy("chunk"))
            .applyInArrow(_reassemble, "doc_id long, n_tokens long, ids binary"))


def _decode(table, block: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offs, values = table.value
        known = np.diff(offs) > 0
        for b in batches:
            out = []
            for x in b.column("ids").to_pylist():
                ids = np.frombuffer(x or b"", "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(known) or not known[ids].all()):
                    raise ValueError("an id has no token")
                out.append(b"".join(_gather(values, offs, ids[i:i + block])[0].tobytes() for i in range(0, len(ids), block)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])
    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ``ids``."""
    ranks = load_ranks(ranks_path)
    size = max(ranks.values(), default=-1) + 1
    token = [b""] * size
    for t, i in ranks.items():
        token[i] = t
    offs = np.concatenate([[0], np.cumsum([len(t) for t in token])]).astype(np.int64)
    table = encoded.sparkSession.sparkContext.broadcast((offs, np.frombuffer(b"".join(token), np.uint8)))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(_decode(table), schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = encode(read_table(spark, sf_dir, "documents"), ranks, P.PATTERN)
    return decode(enc, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                     F.sha2("decoded", 256).alias("decoded_sha256"))
