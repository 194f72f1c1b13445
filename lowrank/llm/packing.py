"""Best-fit packing by minimum bin slack (operator 10).

Documents become token pieces; pieces are packed into sequences of at most
``max_tokens``.  Minimum bin slack fills one bin at a time: the longest
remaining piece goes in, and a subset-sum dynamic program over the
remaining lengths, held as the bits of one integer, finds the fullest
feasible rest.  Bins depend on the lengths alone, so the program runs on the
histogram of lengths (at most ``max_tokens`` rows, whatever the corpus) and
one combination is repeated while its lengths last; the plan stays of that
size.  Pieces take their places by their rank among the pieces of one length:
they are sorted into ranges of bounded size by length, id and their place in the
stored table, and a rank is the place in its range plus the offset of the range,
so neither a length that most pieces share nor a repeated row comes into one task.

Defined cases: null text is empty and is one piece, the end token; the string
of an added token in a text is that token, as in the library; rows repeated
with one doc_id are packed each; equal pieces may exchange places; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.llm.common import by_value, numbered_rows, read_table, save_table, text_blocks
from lowrank.llm.segments import SegmentMemo

by_value(__name__)

MAX_TOKENS = 1024
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies:
    printable Latin-1 ones for themselves, the others in turn from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def piece_encoder(tokenizer_json: str):
    """str -> ids (little-endian unsigned 32-bit integers) as the
    ``tokenizers`` library gives them for that file, without special tokens
    added; the strings of added tokens in a text are these tokens.  A plain
    byte-level BPE whose merges are in the order of their ids (checked) is
    merged by ranks, piece by piece; any other is left to the library, text by text."""
    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, added = model.get("vocab", {}), spec.get("added_tokens") or []
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
             and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
             and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)))
    if not plain:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        return lambda x: np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    import public_tokenizers
    import tiktoken

    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
    encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    memo = SegmentMemo(lambda x: np.array(encode(x), "<u4").tobytes())
    if not added:
        return memo
    own = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
    # At one place the longest of them counts.
    find = re.compile("(" + "|".join(re.escape(t) for t in sorted(own, key=len, reverse=True)) + ")")
    return lambda x: b"".join(own[part] if i % 2 else memo(part) for i, part in enumerate(find.split(x)) if part)


def _pieces(tokenizer, max_tokens: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(tokenizer.value)
        end = np.array([end_id], "<u4").tobytes()
        for rows, texts in text_blocks(batches, "text"):
            out = [[] for _ in range(6)]
            for doc, text in zip(rows.column("doc_id").to_pylist(), texts.to_pylist()):
                raw = encode(text) + end
                n = len(raw) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    ids = raw[4 * a:4 * b]
                    for col, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids), ids)):
                        col.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:k], types)], names=names[:k])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and end token: one if it fits, else
    pieces of ``max_tokens`` after a first one that holds the remainder.
    ``with_ids`` adds the ids (little-endian unsigned 32-bit integers)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, max_tokens, end_id, with_ids), PIECE + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (with repeats) of a fullest combination of at most
    ``room``, longer ones preferred."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[n], room // n)):
            wider = reach | (reach << n) & mask
            if wider == reach:
                break
            steps.append((n, reach))
            reach = wider
        if reach & full:
            break
    left, taken = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> left & 1:
            taken.append(n)
            left -= n
    return taken


def plan_bins(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, how many in each bin)...])]: minimum bin slack."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = [longest, *fullest({n: c for n, c in rest.items() if c}, max_tokens - longest)]
        each = sorted(((n, chosen.count(n)) for n in set(chosen)), reverse=True)
        times = min(left[n] // k for n, k in each)
        plan.append((times, each))
        for n, k in each:
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def _places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, pieces a bin, offset) of each
    combination that uses it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, each in plan:
        offset = 0
        for n, k in each:
            rows.setdefault(n, []).append((used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in rows.items()}


def _assign(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, k, off = table[int(n)]
                j = np.searchsorted(first, rank[at], "right") - 1
                q = rank[at] - first[j]
                sequence[at] = base[j] + q // k[j]
                offset[at] = off[j] + q % k[j] * n
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to the rows of a stored table of pieces."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_bins(counts, max_tokens)))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = numbered_rows(pieces, ["length"], order, "ranked").withColumnRenamed("pos", "rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_assign(places), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return pack(save_table(token_pieces(docs, tokenizer_path, max_tokens), "pieces"), max_tokens)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
