"""Secret scan: base patterns and a randomness test battery (operator 6).

Base kinds are three patterns (``base_spans``).  The method adds spans of kind
``random``.  Candidates are runs of 16 or more key characters, and, judged
apart, the parts of 16 or more between the separators of such a run (segments
of a path).  Each gets an inferred encoding, the smallest alphabet that holds
it, and a battery against randomness within it: chi-squared uniformity, a runs
test about the middle of the alphabet, and lag-1 serial correlation.

A string that the battery rejects (Bonferroni over the three tests) is not
random.  Not being rejected is no evidence in a short string, so the battery's
p-value is combined with a test against ordinary text: the
ratio of the string's probability as uniform characters to that as text in
which each character depends on the one before.  Those transitions are counted in
the corpus, in words too short to be candidates, so that keys do not teach it;
``MIX`` of every transition is uniform, which bounds one step's ratio at any
corpus size.  Ratio times p-value has a mean of at most 1 over text that follows
these transitions (an e-value), so Benjamini-Hochberg on e-values controls the share of false
discoveries at ``FDR``, whatever the dependence, within each stratum of encoding and
length band.  Values are rounded down to tenths of a decade, so the procedure
runs on a histogram of fixed size (strata x levels).  Of a run that is accepted
whole, its parts are not listed again.

One pass counts transitions, one scans; what the scan finds is a small table
written once.  Nothing but the two histograms reaches the driver.

Defined cases: null text is empty; no span, empty lists; rows repeated with
one doc_id are scanned each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import by_value, read_table, save_table, text_blocks, text_bytes

by_value(__name__)

# The base patterns, their order and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the smallest alphabet on; the first that holds a string is inferred.
ENCODINGS = {"digits": _D, "hex": _D + _L[:6], "HEX": _D + _U[:6], "lower": _L, "upper": _U, "base32": _U + "234567", "lower36": _D + _L,
             "upper36": _D + _U, "letters": _U + _L, "base62": _U + _L + _D, "base64": _U + _L + _D + "+/", "base64url": _U + _L + _D + "-_",
             "any": _U + _L + _D + "+/-_"}
BANDS = (24, 32, 48, 64)               # lengths 16-23, 24-31, 32-47, 48-63, more
REJECT = 0.001                         # level of the battery against randomness
FDR = 0.01
MIX = 0.01                             # uniform share of the transitions of ordinary text
LEVELS = 300                           # tenths of a decade of the e-value
PART = re.compile(r"[A-Za-z0-9]{16,}")
SHORTEST = 16                          # characters of a candidate


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, each leftmost and without
    overlaps of its own."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Runs of 32 or more are the runs that stay; shorter ones would be dropped.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_MEMBERS = [(e, frozenset(a)) for e, a in ENCODINGS.items()]


def infer_encoding(s: str) -> int:
    chars = set(s)
    return next(i for i, (_, a) in enumerate(_MEMBERS) if chars <= a)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str, alphabet: str) -> float:
    """Smallest p-value of the three tests against uniform randomness."""
    n, a = len(s), len(alphabet)
    counts = Counter(s)
    chi = a / n * sum(c * c for c in counts.values()) - n
    k = a - 1                                              # Wilson-Hilferty approximation of the upper tail
    z = ((max(chi, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] - (a - 1) / 2 for c in s]
    side = [v > 0 for v in x]
    up = sum(side)
    down = n - up
    if not up or not down:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + sum(p != q for p, q in zip(side, side[1:]))
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    power = sum(v * v for v in x)
    p_serial = _two_sided(sum(p * q for p, q in zip(x, x[1:])) / power * math.sqrt(n)) if power else 0.0
    return min(p_chi, p_runs, p_serial)


def step_ratios(pairs: np.ndarray) -> list[tuple[str, list, list]]:
    """(alphabet, first, step) of each encoding: log10 of how much likelier a first
    character, and a character after another, is in uniform than in ordinary
    text; ``pairs`` counts transitions by byte (128 x 128).  Alphabets of one case read
    both cases alike: capitals spell the same words."""
    lower = np.arange(128)
    lower[65:91] += 32
    folded = np.zeros((128, 128))
    np.add.at(folded, (lower[:, None], lower[None, :]), pairs)
    out = []
    for alphabet in ENCODINGS.values():
        codes = np.array([ord(c) for c in alphabet])
        mixed = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
        counts = pairs[np.ix_(codes, codes)] if mixed else folded[np.ix_(lower[codes], lower[codes])]
        a = len(alphabet)

        def ratio(n):
            total = n.sum(axis=-1, keepdims=True)
            share = np.divide(n, total, out=np.full(n.shape, 1 / a), where=total > 0)
            return -np.log10(a * ((1 - MIX) * share + MIX / a))

        step = np.zeros((128, 128))
        first = np.zeros(128)
        step[np.ix_(codes, codes)] = ratio(counts)
        first[codes] = ratio(counts.sum(axis=1))
        out.append((alphabet, first.tolist(), step.tolist()))
    return out


def e_value(s: str, alphabet: str, first: list, step: list) -> float:
    """log10 of the e-value of a string against ordinary text."""
    x = s.encode()
    ratio = first[x[0]] + sum(step[p][q] for p, q in zip(x, x[1:]))
    if ratio <= 0:
        return ratio                                        # the battery can only lower it
    p = min(1.0, 3 * battery(s, alphabet))
    return ratio + math.log10(p) if p >= REJECT else 0.0


def _scan(pairs: np.ndarray):
    ratios = step_ratios(pairs)

    def judged(s: str) -> tuple[int, int]:
        e = infer_encoding(s)
        level = math.floor(10 * e_value(s, *ratios[e]) + 1e-9)
        return e * (len(BANDS) + 1) + sum(len(s) >= x for x in BANDS), max(0, min(LEVELS, level))

    def candidates(text, spans):
        out = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if any(i <= a and b <= j for i, _, j in spans):
                continue
            whole = judged(m[0])
            out.append((a, b, *whole, None, None))
            for part in PART.finditer(m[0]):
                i, j = a + part.start(), a + part.end()
                if (i, j) != (a, b) and not any(x <= i and j <= y for x, _, y in spans):
                    out.append((i, j, *judged(part[0]), *whole))
        return out

    names = ("start", "end", "stratum", "level", "outer_stratum", "outer_level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        cand = pa.list_(pa.struct([(n, pa.int64() if n in ("start", "end") else pa.int32()) for n in names]))
        for rows, texts in text_blocks(batches, "text"):
            base, more = [], []
            for text in texts.to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                more.append([dict(zip(names, c)) for c in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("digest"), pa.array(base, span), pa.array(more, cand)],
                                             names=["doc_id", "digest", "base", "more"])
    return run


_ALNUM, _KEY = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[ord(c) for c in _D + _L + _U]] = True
_KEY[[ord(c) for c in ENCODINGS["any"]]] = True


def transitions(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts (128 x 128) of neighbouring key characters in one text, but those
    inside of ``SHORTEST`` or more letters and digits on end."""
    if len(data) < 2:
        return np.zeros((128, 128), np.int64)
    same = np.ones(len(data), bool)
    same[offs[:-1][offs[:-1] < len(data)]] = False          # the first byte of a text has none before it
    word = _ALNUM[data]
    new = word.copy()
    new[1:] = word[1:] & (~word[:-1] | ~same[1:])
    run = np.cumsum(new) * word
    length = np.bincount(run)
    long = word & (length[run] >= SHORTEST)
    key = _KEY[data]
    use = key[1:] & key[:-1] & same[1:] & ~(long[1:] & long[:-1])
    return np.bincount(data[:-1][use].astype(np.int64) * 128 + data[1:][use], minlength=1 << 14).reshape(128, 128)


def _count_transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((128, 128), np.int64)
    for _, texts in text_blocks(batches, "text"):
        total += transitions(*text_bytes(texts))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used])], names=["pair", "n"])


def control_levels(histogram: dict[tuple[int, int], int], fdr: float = FDR) -> dict[int, int]:
    """stratum -> least level that Benjamini-Hochberg accepts."""
    by: dict[int, dict[int, int]] = {}
    for (stratum, level), n in histogram.items():
        by.setdefault(stratum, {})[level] = n
    out = {}
    for stratum, levels in by.items():
        total, seen = sum(levels.values()), 0
        for level in sorted(levels, reverse=True):
            seen += levels[level]
            if 10 ** (-level / 10) * total <= fdr * seen:
                out[stratum] = level
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, digest, spans): hash of the text and an array of (start, kind,
    end), kind a number in ``KINDS``, in code points, in order of start and kind."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    counts = rows.mapInArrow(_count_transitions, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(1 << 14)                   # at most 66 x 66 rows came
    pairs[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    found = save_table(rows.mapInArrow(
        _scan(pairs.reshape(128, 128)), "doc_id long, digest long, base array<struct<start:long,kind:int,end:long>>, "
        "more array<struct<start:long,end:long,stratum:int,level:int,outer_stratum:int,outer_level:int>>"), "secrets")
    histogram = found.select(F.explode("more").alias("c")).groupBy("c.stratum", "c.level").count().collect()
    least = control_levels({(r["stratum"], r["level"]): r["count"] for r in histogram}, fdr)
    strata = len(ENCODINGS) * (len(BANDS) + 1)
    table = F.array(*[F.lit(least.get(i, LEVELS + 1)) for i in range(strata)])
    accepted = lambda c, of="": c[f"{of}level"] >= F.get(table, c[f"{of}stratum"])
    random = F.transform(F.filter("more", lambda c: accepted(c) & ~F.coalesce(accepted(c, "outer_"), F.lit(False))),
                         lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "digest", F.sort_array(F.concat("base", random)).alias("spans"))


def _masked(mask: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("__spans").to_pylist()):
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [out[i][at:s["start"]], mask]
                        at = max(at, s["end"])
                    out[i] = "".join([*parts, out[i][at:]])
            cols = {n: b.column(n) for n in names} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` (doc_id, text, more) with every span replaced by ``mask``;
    overlapping spans share one.  Rows without spans stay as they are."""
    found = (find_secrets(docs, fdr=fdr).where(F.size("spans") > 0).groupBy("doc_id", "digest").agg(F.first("spans").alias("__spans"))
             .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__spans"))
    same = docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["__digest"])
    joined = docs.join(found, same, "left").select(*[docs[f"`{n}`"] for n in docs.columns], "__spans")
    return joined.mapInArrow(_masked(mask, docs.columns), docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
