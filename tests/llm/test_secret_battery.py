"""op6's added kind against a plain version: transitions, battery, e-values,
false-discovery control and spans; recall of short keys; segments of paths."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lowrank.llm import secrets
from lowrank.llm.common import text_bytes

RNG = random.Random(11)
STEMS = ["river", "stone", "network", "haus", "Getriebe", "camino", "nuevo", "partition", "Schluessel", "windows", "index", "the", "of", "und", "con"]
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
KEY = ALNUM + "+/_-"


def prose(n):
    return " ".join(RNG.choice(STEMS) for _ in range(n)) + f" {RNG.randint(0, 9999)}"


def key(encoding, n):
    return "".join(RNG.choice(secrets.ENCODINGS[encoding]) for _ in range(n))


HIDDEN = key("base62", 20)
KEYS = [key("base62", 16), key("lower36", 20), key("base64url", 24), key("base32", 16), key("lower", 20), key("base62", 40)]
ROWS = [(i, prose(60)) for i in range(40)]
ROWS += [(100 + i, f"Üñí ß {prose(10)} {k}, {prose(10)}") for i, k in enumerate(KEYS)]
ROWS += [(200, f"src/main/{HIDDEN}/index/windows/partition/network/river/haus/of/the/stone/camino/nuevo/windows/index/river/of/stone/the/network"),
         (201, "src/main/index/windows/partition and snake_case_name_of_the_index and riverStoneNetworkPartition"), (202, "-" * 40 + " " + "=" * 30),
         (203, "abcdefghijklmnopqrstuvwxyz 012345678901234567890123456789"), (204, None), (205, ""), (206, " \n "),
         (100, ROWS[40][1]), (None, f"null id {KEYS[0]}"), (207, prose(30000) + " " + KEYS[1]),
         (208, f'secret = "{KEYS[2]}" AKIA{key("upper36", 16)} {key("hex", 40)}')]


def plain_pairs(texts):
    """Transitions between key characters, but inside of long alphanumeric runs."""
    total = Counter()
    for text in texts:
        for run in re.findall(r"[A-Za-z0-9+/_-]+", text or ""):
            for piece in re.findall(r"[A-Za-z0-9]+|[+/_-]", run):
                if len(piece) < 16:
                    total.update(zip(piece, piece[1:]))
            pieces = re.findall(r"[A-Za-z0-9]+|[+/_-]", run)
            total.update((p[-1], q[0]) for p, q in zip(pieces, pieces[1:]))
    return total


def plain_battery(s, alphabet):
    n, a = len(s), len(alphabet)
    chi = sum((s.count(c) - n / a) ** 2 / (n / a) for c in alphabet)
    h = 2 / (9 * (a - 1))
    upper = 0.5 * math.erfc(((chi / (a - 1)) ** (1 / 3) - 1 + h) / math.sqrt(2 * h))
    x = [alphabet.index(c) - (a - 1) / 2 for c in s]
    ups, downs = sum(v > 0 for v in x), sum(v <= 0 for v in x)
    if ups and downs:
        runs = 1 + sum((p > 0) != (q > 0) for p, q in zip(x, x[1:]))
        mean = 1 + 2 * ups * downs / n
        var = 2 * ups * downs * (2 * ups * downs - n) / (n * n * (n - 1))
        runs_p = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 1e-12 else 1.0
    else:
        runs_p = 0.5 ** (n - 1)
    r1 = sum(p * q for p, q in zip(x, x[1:])) / sum(v * v for v in x)
    return min(upper, runs_p, math.erfc(abs(r1) * math.sqrt(n / 2)))


def plain_e(s, pairs):
    name = next(k for k, a in secrets.ENCODINGS.items() if set(s) <= set(a))
    a = secrets.ENCODINGS[name]
    both = any(c.islower() for c in a) and any(c.isupper() for c in a)
    fold = (lambda c: c) if both else str.lower
    table = Counter()
    for (p, q), n in pairs.items():
        table[fold(p), fold(q)] += n
    inside = {c: {d: table[fold(c), fold(d)] for d in a} for c in a}

    def share(n, total):
        return (1 - secrets.MIX) * (n / total if total else 1 / len(a)) + secrets.MIX / len(a)

    sums = {c: sum(inside[c].values()) for c in a}
    e = -math.log10(len(a) * share(sums[s[0]], sum(sums.values())))
    e -= sum(math.log10(len(a) * share(inside[p][q], sums[p])) for p, q in zip(s, s[1:]))
    p = min(1, 3 * plain_battery(s, a))
    return name, e if e <= 0 else e + math.log10(p) if p >= secrets.REJECT else 0


def plain_spans(rows):
    pairs = plain_pairs([t for _, t in rows])
    found, by = [], {}
    for at, (_, text) in enumerate(rows):
        text = text or ""
        base = secrets.base_spans(text)
        free = lambda i, j: not any(x <= i and j <= y for x, _, y in base)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text):
            if not free(*m.span()):
                continue
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9]{16,}", m[0]) if p[0] != m[0]]
            for i, j in [m.span(), *(p for p in parts if free(*p))]:
                name, e = plain_e(text[i:j], pairs)
                band = sum(j - i >= x for x in (24, 32, 48, 64))
                level = max(0, min(300, math.floor(10 * e + 1e-9)))
                by.setdefault((name, band), []).append(level)
                found.append((at, i, j, (name, band), level, m.span()))
    cut = {}
    for stratum, levels in by.items():
        good = [x for x in levels if 10 ** (x / 10) >= len(levels) / (secrets.FDR * sum(y >= x for y in levels))]
        cut[stratum] = min(good, default=10 ** 9)
    kept = {(at, i, j) for at, i, j, stratum, level, _ in found if level >= cut[stratum]}
    kept = {(at, i, j) for at, i, j, _, _, whole in found if (at, i, j) in kept and ((i, j) == whole or (at, *whole) not in kept)}
    return [sorted(secrets.base_spans(t or "") + [(i, 3, j) for a, i, j in kept if a == at]) for at, (_, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(d, t, "x", [1], 2) for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, more array<int>, level int").repartition(5)
    return sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secrets.find_secrets(docs).collect()), key=str)


def test_spans_equal_the_plain_version(got):
    assert got == sorted(((d, s) for (d, _), s in zip(ROWS, plain_spans(ROWS))), key=str)


def test_short_keys_and_segments_are_found_and_words_are_not(got):
    spans = {d: s for d, s in got}
    text = dict(ROWS)
    for i, k in enumerate(KEYS):
        assert [text[100 + i][a:b] for a, kind, b in spans[100 + i] if kind == 3] == [k]
    assert [text[200][a:b] for a, _, b in spans[200]] == [HIDDEN]
    assert not [d for d in [*range(40), 201, 202, 203, 204, 205, 206] if spans[d]]
    assert text[207][spans[207][0][0]:spans[207][0][2]] == KEYS[1]
    assert [k for _, k, _ in spans[208]] == [0, 1, 2]


def test_transitions_are_counted_within_texts():
    texts = ["ab", "", "ba-c", "x" * 16 + "/y", "é a+b", "q" * 15]
    n = secrets.transitions(*text_bytes(pa.array(texts, pa.large_string())))
    have = {(chr(i), chr(j)): int(n[i, j]) for i, j in zip(*np.nonzero(n))}
    assert have == dict(plain_pairs(texts))


@pytest.mark.parametrize("encoding", ["base62", "base64url", "lower36", "base32", "lower", "hex"])
@pytest.mark.parametrize("n", [16, 20, 24, 28, 32])
def test_recall_by_length(encoding, n):
    """Share of 400 random keys past 10^2 (a stratum of keys only) and past
    10^7 (one key among 100,000 candidates)."""
    ratios = secrets.step_ratios(secrets.transitions(*text_bytes(pa.array([t or "" for _, t in ROWS], pa.large_string()))))
    r = random.Random(n)
    e = [secrets.e_value(s, *ratios[secrets.infer_encoding(s)])
         for s in ("".join(r.choice(secrets.ENCODINGS[encoding]) for _ in range(n)) for _ in range(400))]
    assert sum(x >= 2 for x in e) >= 0.95 * 400
    assert sum(x >= 7 for x in e) >= 0.9 * 400


def test_query_lists_spans_of_all_kinds(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in secrets.op6_secrets(spark, str(tmp_path)).collect()}
    for i, spans in enumerate(plain_spans(ROWS)):
        listed = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        base = ",".join(x for x in listed if not x.startswith("random"))
        assert out[i]["spans"] == ",".join(listed) and out[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
