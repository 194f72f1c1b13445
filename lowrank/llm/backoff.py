"""Katz backoff language model over a whole corpus (operator 12).

Order 2: the probability of a word after another is its Good-Turing
discounted relative count where the pair was seen, else the history's backoff weight
times the probability of the word alone, which in turn is discounted and
leaves its mass to the one unknown word.  Weights are exactly normalised: what
the discounts of a history leave over, divided by the lower-order
mass of the words not seen after it, so each history sums to one over the
vocabulary, the end of text and the unknown word.

Nothing travels word by word.  Texts are cut into chunks of a bounded number of
bytes; a chunk sends its distinct words to buckets by hash and gets an id for
each (buckets first count, then ids follow the training count: all words of
one count share a range of ids, so the table count -> first id, at most
sqrt(2 N) rows, lets any task turn ids into counts).  The chunk then sends its
distinct pairs to the buckets of their histories, where the training counts add
up to the stored, partitioned pair table, one row a bucket; a second pass
over that table looks up each chunk's pairs and answers with their counts and the
weights of histories that back off.  The chunk puts the answers in the order of
its tokens and adds up its documents.

Hot keys: a word or pair counts once per chunk; a history of more than
``N / (4 buckets)`` tokens is spread over the buckets by pair, and its parts of the
normalisation (at most 4 buckets histories) are summed by Spark.

Discounts are Good-Turing for counts up to 5 where all of them lie between 0
and 1, else absolute (n1 / (n1 + 2 n2), or 1/2).  A history none of whose pairs is
discounted counts one more token, so that something is left to back off to.

Defined cases: null text is empty and is one token, the end; a null id is no
number, so such rows are in training; rows repeated with one id are scored (and learned) each; texts
longer than a chunk are chunks of their own; without training rows every word has
probability one (score 0); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import Numbers, by_value, drop_table, read_table, save_table, shuffle_partitions, text_blocks

by_value(__name__)

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20            # text bytes per bucket of words or pairs
DISCOUNTED = 5                     # the largest count that is discounted
ADD = 0.1                          # of the base score
UNKNOWN, START = 0, 1              # ids before those of the words


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(blob: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, size)) if size else b""


def pack(x: np.ndarray) -> bytes:
    """Non-negative numbers as compressed byte planes."""
    return _press(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_expand(blob, 8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text and the end, written as the empty
    word; ``bytes.split`` cuts at exactly the six ASCII white spaces."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), b""]


class _Chunk(NamedTuple):
    key: int
    docs: list
    held: list[bool]
    sizes: list[int]
    words: list[bytes]             # distinct, in order of first use
    tokens: np.ndarray             # numbers of the words, all documents


def _chunks(batches, limit: int) -> Iterator[_Chunk]:
    for rows, texts in text_blocks(batches, "text", limit):
        docs, held, numbers = rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), Numbers()
        digest, parts, sizes = hashlib.blake2b(digest_size=8), [], []
        for d, text in zip(docs, texts.to_pylist()):
            digest.update(f"{d}:{len(text)};".encode())
            digest.update(text.encode("utf-8", "surrogatepass"))
            words = words_of(text)
            sizes.append(len(words))
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        yield _Chunk(int.from_bytes(digest.digest(), "little", signed=True), docs, held, sizes, list(numbers), np.concatenate(parts))


def _by_bucket(words: list[bytes], buckets: int) -> list[list[int]]:
    """Numbers of the words of each bucket, in order of first use."""
    out = [[] for _ in range(buckets)]
    for i, w in enumerate(words):
        out[zlib.crc32(w) % buckets].append(i)
    return out


def _train(chunk_sizes, held) -> np.ndarray:
    return np.repeat(~np.asarray(held, bool), chunk_sizes)


def _send_words(limit: int, buckets: int):
    """A row per chunk and bucket: its distinct words and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, limit):
            count = np.bincount(c.tokens[_train(c.sizes, c.held)], minlength=len(c.words))
            rows = []
            for b, mine in enumerate(_by_bucket(c.words, buckets)):
                raw = b"\n".join(c.words[i] for i in mine)     # words hold no line ends
                if mine:
                    rows.append((b, c.key, len(mine), len(raw), _press(raw), pack(count[mine])))
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             names=["bucket", "chunk", "n", "bytes", "words", "counts"])
    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Training counts of a bucket's words and their ranks among the bucket's
    words of one count: for every chunk, and the sizes of the counts' classes."""
    rows = table.to_pylist()
    numbers, lists = Numbers(), []
    for r in rows:
        words = _expand(r["words"], r["bytes"]).split(b"\n")
        lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, r["n"]))
    count = np.zeros(len(numbers), np.int64)
    for r, mine in zip(rows, lists):
        count[mine] += unpack(r["counts"], r["n"])             # distinct within a chunk
    # Ranks follow the words themselves, so a task that runs again gives the same ids.
    words = list(numbers)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(count[order], kind="stable")]
    classes, first, n = np.unique(count[order], return_index=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words)) - np.repeat(first, n)
    seen = classes > 0
    bucket = rows[0]["bucket"]
    out = {"chunk": [r["chunk"] for r in rows] + [None], "bucket": [bucket] * (len(rows) + 1), "n": [r["n"] for r in rows] + [0],
           "counts": [pack(count[m]) for m in lists] + [None], "ranks": [pack(rank[m]) for m in lists] + [None],
           "classes": [None] * len(rows) + [[{"count": int(c), "words": int(k)} for c, k in zip(classes[seen], n[seen])]]}
    return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["n"], pa.int32()),
                     pa.array(out["counts"], pa.binary()), pa.array(out["ranks"], pa.binary()),
                     pa.array(out["classes"], pa.list_(pa.struct([("count", pa.int64()), ("words", pa.int64())])))], names=list(out))


class Vocabulary(NamedTuple):
    """Words by training count: ``counts`` falling, the first id of each, the
    number of words; ids of one count are ``first + rank * buckets + bucket``."""
    counts: np.ndarray
    first: np.ndarray
    words: np.ndarray
    buckets: int
    tokens: int                    # N
    texts: int                     # training documents: the count of the start
    discount: np.ndarray           # by count, 0 to DISCOUNTED
    unknown: float                 # probability of the unknown word

    def ids(self, count: np.ndarray, rank: np.ndarray, bucket: int) -> np.ndarray:
        at = np.searchsorted(-self.counts, -count)
        known = count > 0
        return np.where(known, self.first[np.where(known, at, 0)] + rank * self.buckets + bucket, UNKNOWN) if len(self.counts) else np.zeros(len(count), np.int64)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words; of the start, the number of texts."""
        if not len(self.counts):
            return np.zeros(len(ids), np.int64)
        out = self.counts[np.maximum(np.searchsorted(self.first, ids, "right") - 1, 0)]
        return np.where(ids > START, out, np.where(ids == START, self.texts, 0))

    def probability(self, ids: np.ndarray) -> np.ndarray:
        """P(word) of the lowest order."""
        c = self.count(ids)
        return np.where(c > 0, c * discount_of(self.discount, c) / max(1, self.tokens), self.unknown)


def discounts(n_of: np.ndarray) -> np.ndarray:
    """Factors d_r for r = 0..DISCOUNTED from n_r, the numbers of types that occur
    r times (r = 0..DISCOUNTED + 1): Good-Turing, else absolute."""
    k, n = DISCOUNTED, np.asarray(n_of, np.float64)
    r = np.arange(1, k + 1)
    d = np.ones(k + 1)
    if (n[1:k + 2] > 0).all():
        a = (k + 1) * n[k + 1] / n[1]
        d[1:] = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - a) / (1 - a) if a != 1 else 0.0
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        d[1:] = (r - off) / r
    return d


def discount_of(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count <= DISCOUNTED, d[np.minimum(count, DISCOUNTED)], 1.0)


def vocabulary(classes: list[tuple[int, int, int]], buckets: int, texts: int) -> Vocabulary:
    """From (count, most words in one bucket, words), counts falling."""
    counts, most, words = (np.array([c[i] for c in classes], np.int64) for i in range(3))
    first = START + 1 + np.concatenate([[0], np.cumsum(most * buckets)])[:-1]
    tokens = int((counts * words).sum())
    n_of = np.array([words[counts == r].sum() for r in range(DISCOUNTED + 2)])
    d = discounts(n_of)
    left = float((words * counts * (1 - discount_of(d, counts))).sum()) / tokens if tokens else 1.0
    if tokens and left <= 0:       # no count is small: one more token, the unknown word's
        left = 1.0 / (tokens + 1)
    return Vocabulary(counts, first, words, buckets, tokens, texts, d, left)


def _send_tokens(limit: int):
    """A row per chunk: its documents and the numbers of its words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, limit):
            order = np.argsort(-np.bincount(c.tokens, minlength=len(c.words)), kind="stable")
            code = np.empty(len(order), np.int64)
            code[order] = np.arange(len(order))
            buckets = np.array([zlib.crc32(w) for w in c.words], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.key]), pa.array([c.docs], pa.list_(pa.int64())), pa.array([c.held], pa.list_(pa.bool_())),
                 pa.array([c.sizes], pa.list_(pa.int64())), pa.array([len(order)], pa.int32()), pa.array([pack(order)], pa.binary()),
                 pa.array([pack(buckets)], pa.binary()), pa.array([pack(code[c.tokens])], pa.binary())],
                names=["chunk", "docs", "held", "sizes", "n_words", "order", "hashes", "tokens"])
    return run


def _encode(vocab):
    """Chunks with the ids of their tokens, from their words' counts and ranks."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocab.value
        answers = {r["bucket"]: r for r in right.to_pylist()}  # equal chunks: equal answers
        out = []
        for row in left.to_pylist():
            n = row["n_words"]
            place = unpack(row["hashes"], n) % v.buckets
            ids = np.empty(n, np.int64)
            for b, r in answers.items():
                mine = np.flatnonzero(place == b)              # in order of first use, as sent
                if len(mine) != r["n"]:
                    raise ValueError("a chunk differs between the two readings of the table")
                ids[mine] = v.ids(unpack(r["counts"], r["n"]), unpack(r["ranks"], r["n"]), b)
            if sum(r["n"] for r in answers.values()) != n:
                raise ValueError("a chunk differs between the two readings of the table")
            tokens = ids[unpack(row["order"], n)[unpack(row["tokens"], int(sum(row["sizes"])))]]
            out.append((row["chunk"], row["docs"], row["held"], row["sizes"], pack(tokens)))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, types)], names=["chunk", "docs", "held", "sizes", "ids"])
    return run


class _Pairs(NamedTuple):
    """Distinct pairs of a chunk by (bucket, history, word)."""
    bucket: np.ndarray
    history: np.ndarray
    word: np.ndarray
    trained: np.ndarray            # training count in the chunk
    of_token: np.ndarray           # number of the pair of each token


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _place(v: Vocabulary, history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Buckets of pairs: by history, for hot ones by pair."""
    hot = v.count(history) * 4 * v.buckets > v.tokens
    return (_mix(np.where(hot, history + (word << 24) + 1, history)) % np.uint64(v.buckets)).astype(np.int64)


def _pairs(v: Vocabulary, ids: np.ndarray, sizes, held) -> _Pairs:
    history = np.empty(len(ids), np.int64)
    history[1:] = ids[:-1]
    sizes = np.asarray(sizes, np.int64)
    history[np.cumsum(sizes) - sizes] = START
    # Words of a chunk are numbered anew, so that a pair is one number.
    w, w_at = np.unique(ids, return_inverse=True)
    h, h_at = np.unique(history, return_inverse=True)
    pair, of_token = np.unique(h_at * len(w) + w_at, return_inverse=True)
    history, word = h[pair // max(1, len(w))], w[pair % max(1, len(w))]
    bucket = _place(v, history, word)
    order = np.argsort(bucket, kind="stable")                  # within a bucket still by (history, word)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    of_token = number[of_token]
    trained = np.bincount(of_token[_train(sizes, held)], minlength=len(order))
    return _Pairs(bucket[order], history[order], word[order], trained, of_token)


def _send_pairs(vocab):
    """A row per chunk and bucket: its distinct pairs and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("chunk", "held", "sizes", "ids")}
                p = _pairs(v, unpack(row["ids"], int(sum(row["sizes"]))), row["sizes"], row["held"])
                cut = np.searchsorted(p.bucket, np.arange(v.buckets + 1))
                rows = [(b, row["chunk"], int(z - a), pack_sorted(p.history[a:z]), pack(p.word[a:z]), pack(p.trained[a:z]))
                        for b, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                                 names=["bucket", "chunk", "n", "history", "word", "counts"])
    return run


_ASK = pa.struct([("chunk", pa.int64()), ("n", pa.int32()), ("at", pa.binary())])


def _count_pairs(table: pa.Table) -> pa.Table:
    """One row a bucket: the pair table (all pairs asked for, 0 where not in
    training) and the places of each chunk's pairs in it."""
    rows = table.to_pylist()
    history = np.concatenate([unpack_sorted(r["history"], r["n"]) for r in rows])
    word = np.concatenate([unpack(r["word"], r["n"]) for r in rows])
    order = np.lexsort((word, history))
    h, w = history[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    h, w = h[new], w[new]
    count, asks, at = np.zeros(len(h), np.int64), [], 0
    for r in rows:
        mine = number[at:at + r["n"]]
        at += r["n"]
        count[mine] += unpack(r["counts"], r["n"])             # distinct within a chunk
        asks.append({"chunk": r["chunk"], "n": r["n"], "at": pack_sorted(mine)})
    n_of = np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:DISCOUNTED + 2]
    return pa.table([pa.array([rows[0]["bucket"]], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([pack_sorted(h)], pa.binary()),
                     pa.array([pack(w)], pa.binary()), pa.array([pack(count)], pa.binary()), pa.array([n_of.tolist()], pa.list_(pa.int64())),
                     pa.array([asks], pa.list_(_ASK))], names=["bucket", "n", "history", "word", "counts", "n_of", "asks"])


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each history of a sorted column, and each row's group."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _parts(v: Vocabulary, d: np.ndarray, row) -> tuple[np.ndarray, ...]:
    """(history, freed count, lower-order mass of its seen words, group of
    each pair) of the histories in a bucket, and its counts."""
    n = row["n"]
    h, w, c = unpack_sorted(row["history"], n), unpack(row["word"], n), unpack(row["counts"], n)
    first, group = _groups(h)
    freed = np.bincount(group, c * (1 - discount_of(d, c)), len(first))
    mass = np.bincount(group, np.where(c > 0, v.probability(w), 0.0), len(first))
    return h[first], freed, mass, group, c


def _weights(total: np.ndarray, freed: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, extra count) per history; an unseen one backs off freely."""
    extra = (freed <= 0) & (total > 0)
    left = np.divide(np.where(extra, 1.0, freed), total + extra, out=np.ones(len(total)), where=total > 0)
    return left / np.where(total > 0, np.maximum(1 - mass, 1e-300), 1.0), extra


def _hot_parts(vocab, d: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            for row in batch.to_pylist():
                h, freed, mass, _, _ = _parts(v, d, row)
                hot = v.count(h) * 4 * v.buckets > v.tokens
                yield pa.RecordBatch.from_arrays([pa.array(h[hot]), pa.array(freed[hot]), pa.array(mass[hot])], names=["h", "freed", "mass"])
    return run


def _answer(vocab, d: np.ndarray, hot):
    """Per chunk and bucket: of each pair its training count (twice that, plus one
    where its history counts one more token), and the weights of the pairs that back off."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, shared = vocab.value, hot.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("bucket", "n", "history", "word", "counts")}
                h, freed, mass, group, c = _parts(v, d, row)
                for j in np.flatnonzero(v.count(h) * 4 * v.buckets > v.tokens):
                    freed[j], mass[j] = shared[int(h[j])]
                weight, extra = _weights(v.count(h), freed, mass)
                code, weight = 2 * c + extra[group], weight[group]
                for ask in batch.column("asks")[i].values.to_pylist() if batch.column("asks")[i].is_valid else []:
                    at = unpack_sorted(ask["at"], ask["n"])
                    back = weight[at][c[at] == 0]
                    distinct, which = np.unique(back, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ask["chunk"]]), pa.array([row["bucket"]], pa.int32()), pa.array([ask["n"]], pa.int32()),
                         pa.array([pack(code[at])], pa.binary()), pa.array([distinct.tolist()], pa.list_(pa.float64())),
                         pa.array([pack(which)], pa.binary())],
                        names=["chunk", "bucket", "n", "codes", "weights", "which"])
    return run


def _score(vocab, d: np.ndarray):
    """Scores of the documents of a chunk from the answers to its pairs."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocab.value
        answers = {r["bucket"]: r for r in right.to_pylist()}  # equal chunks: equal answers
        floor = ADD / (v.tokens + ADD * (int(v.words.sum()) + 1))
        out = [[] for _ in range(6)]
        for row in left.to_pylist():
            sizes = np.asarray(row["sizes"], np.int64)
            ids = unpack(row["ids"], int(sizes.sum()))
            p = _pairs(v, ids, sizes, row["held"])
            cut = np.searchsorted(p.bucket, np.arange(v.buckets + 1))
            code, weight = np.empty(len(p.bucket), np.int64), np.ones(len(p.bucket))
            for b in np.unique(p.bucket):
                a, z, r = cut[b], cut[b + 1], answers[int(b)]
                code[a:z] = unpack(r["codes"], r["n"])
                unseen = a + np.flatnonzero(code[a:z] < 2)
                weight[unseen] = np.asarray(r["weights"])[unpack(r["which"], len(unseen))] if len(unseen) else 1.0
            c = code // 2
            seen = c * discount_of(d, c) / np.maximum(1, v.count(p.history) + code % 2)
            log = np.log10(np.where(c > 0, seen, weight * v.probability(p.word)))
            count = v.count(ids)
            start = np.cumsum(sizes) - sizes
            out[0] += row["docs"]
            out[1] += row["held"]
            out[2] += sizes.tolist()
            out[3] += np.add.reduceat((count > 0).astype(np.int64), start).tolist()
            out[4] += np.add.reduceat(np.log10((count + ADD) / ADD * floor), start).tolist()
            out[5] += np.add.reduceat(log[p.of_token], start).tolist()
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        cols = [pa.array(x, t) for x, t in zip(out, types)]
        return pa.table([*cols, pa.array(np.full(len(out[0]), v.tokens))], names=[*names, "train_tokens"])
    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens):
    every row scored by the model of the rows where ``held_out`` is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("texts")).first()
    buckets = buckets or max(shuffle_partitions(spark), -(-(size["bytes"] or 0) // BUCKET_BYTES))

    sent = rows.mapInArrow(_send_words(chunk_bytes, buckets), "bucket int, chunk long, n int, bytes long, words binary, counts binary")
    counted = save_table(sent.groupBy("bucket").applyInArrow(
        _count_words, "chunk long, bucket int, n int, counts binary, ranks binary, classes array<struct<count:long,words:long>>"), "lm-words")
    classes = (counted.where("chunk is null").select(F.inline("classes")).groupBy("count")
               .agg(F.max("words").alias("most"), F.sum("words").alias("words")).collect())       # at most sqrt(2 N) rows
    table = vocabulary(sorted(((r["count"], r["most"], r["words"]) for r in classes), reverse=True), buckets, size["texts"])
    vocab = spark.sparkContext.broadcast(table)

    tokens = rows.mapInArrow(_send_tokens(chunk_bytes), "chunk long, docs array<long>, held array<boolean>, sizes array<long>, "
                             "n_words int, order binary, hashes binary, tokens binary")
    chunks = save_table(tokens.groupBy("chunk").cogroup(counted.where("chunk is not null").groupBy("chunk")).applyInArrow(
        _encode(vocab), "chunk long, docs array<long>, held array<boolean>, sizes array<long>, ids binary"), "lm-chunks")
    drop_table(counted)

    asked = chunks.mapInArrow(_send_pairs(vocab), "bucket int, chunk long, n int, history binary, word binary, counts binary")
    pairs = save_table(asked.groupBy("bucket").applyInArrow(
        _count_pairs, "bucket int, n long, history binary, word binary, counts binary, n_of array<long>, "
        "asks array<struct<chunk:long,n:int,at:binary>>"), "lm-pairs")
    n_of = pairs.agg(*(F.sum(F.col("n_of")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 2))).first()
    d = discounts(np.array([x or 0 for x in n_of]))
    part = pairs.select("n", "history", "word", "counts").mapInArrow(_hot_parts(vocab, d), "h long, freed double, mass double")
    hot = {r["h"]: (r["freed"], r["mass"]) for r in                                               # at most 4 buckets + 1 rows
           part.groupBy("h").agg(F.sum("freed").alias("freed"), F.sum("mass").alias("mass")).collect()}
    answers = pairs.mapInArrow(_answer(vocab, d, spark.sparkContext.broadcast(hot)),
                               "chunk long, bucket int, n int, codes binary, weights array<double>, which binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(vocab, d), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_texts(read_table(spark, sf_dir, "documents"), held_out)
