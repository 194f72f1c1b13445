"""op2 against a plain version: hashes, bins, densification, low bits,
likeness, edited texts and neighbours."""

import hashlib
import random

from lowrank.llm import fingerprints

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
RNG = random.Random(2)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 5))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(400)
ROWS = [(3, LONG), (5, LONG + " tail"), (9, None), (11, ""), (12, " \t\n"), (20, "two words"), (21, prose(5)), (40, prose(20000)),
        (41, prose(30)), (42, LONG), (60, "日本 " * 90), (61, "a\nb\fc\x0bd e\x1cf g"), (62, prose(12)), (90, prose(700))]


def mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) & M
    return h ^ (h >> 33)


def span_hash(values):
    total, power = len(values), 1
    for v in values:
        total += (v + 1) * power
        power = power * BASE & M
    return mix(total & M)


def plain_bins(text):
    word, words = bytearray(), []
    for b in (text or "").encode() + b" ":
        if b == 0x20 or 9 <= b <= 13:
            if word:
                words.append(span_hash(word))
            word = bytearray()
        else:
            word.append(b)
    if not words:
        return None
    k, bins = min(5, len(words)), [None] * 256
    for i in range(len(words) - k + 1):
        h = span_hash(words[i:i + k])
        at, rest = h >> 56, h & ((1 << 56) - 1)
        bins[at] = rest if bins[at] is None else min(bins[at], rest)
    out = []
    for j, x in enumerate(bins):
        attempt = 0
        while x is None:
            attempt += 1
            x = bins[mix((j * BASE + attempt) & M) % 256 if attempt <= 16 * 256 else (j + attempt) % 256]
        out.append(mix(x) & 255)
    return bytes(out)


def plain_likeness(a, b):
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    share = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (share - 1 / 256) / (255 / 256)))


def test_query_equals_the_plain_version(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, bucket string, peek int").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(ROWS)
    for (d, text), (_, after) in zip(ROWS, ROWS[1:] + ROWS[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        own, changed, nxt = plain_bins(text), plain_bins(edited), plain_bins(after)
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == (own.hex() if own else fingerprints.NONE)
        assert r["edited_fingerprint"] == (changed.hex() if changed else fingerprints.NONE)
        assert abs(r["near_edited"] - plain_likeness(own, changed)) < 1e-12
        assert abs(r["near_next"] - plain_likeness(own, nxt)) < 1e-12


def test_likeness_estimates_shingle_jaccard(spark):
    a = prose(3000).split()
    b = a[:2250] + prose(750).split()
    sets = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    jaccard = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(plain_likeness(plain_bins(" ".join(a)), plain_bins(" ".join(b))) - jaccard) < 0.12
