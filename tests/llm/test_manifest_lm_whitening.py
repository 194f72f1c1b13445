"""Merkle manifest, backoff model and whitening against plain Python, on rows
with nulls, empty and long texts, ties, repeats and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lowrank.llm import backoff, merkle, whiten
from lowrank.llm.common import numbered_rows, save_table

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdeABC") for _ in range(RNG.randint(1, 5))) for _ in range(300)]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n):
    return " ".join(RNG.choice(WORDS[:RNG.choice((5, 40, 300))]) for _ in range(n))


ROWS = ([(i, prose(RNG.randint(1, 60)), ["en", "de", None, "É"][min(3, i % 7)], "web", i, "x", "y") for i in range(150)]
        + [(None, "Null id", "en", None, None, "x", "y"), (None, "Another null id", "en", "web", 3, "x", "y"), (200, None, "en", "web", 0, "x", "y"),
           (201, "", "fr", "web", 0, "x", "y"), (202, prose(9000), "en", "web", 1, "x", "y"), (203, "Üñí ß x  A\x0bB", None, "web", 1, "x", "y")]
        + [(204, "Twice the same row", "en", "web", 4, "x", "y")] * 3)
NAMES = "doc_id long, text string, lang string, source string, n_chars int, chunk string, leaf string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, NAMES).repartition(4)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=8):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i - i % fanout
            out.append((level[a:i], level[i + 1:a + fanout]))
            i //= fanout
        return out

    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        groups[r[2]].append((r[0], leaf(r, r[1]), leaf(r, r[1].translate(LOW) if hit else r[1])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc, own, shown) in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            folded = shown
            for a, b in steps:
                folded = sha(*a, folded, *b)
            out.append((doc, own, trees[g][-1][0], top[-1][0], sha(*(x for a, b in steps for x in a + b)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,local", [(8, 4), (2, 1), (3, 2)])
def test_manifest_equals_plain_tree(docs, fanout, local):
    got = merkle.manifest(merkle.leaves(docs), fanout, local).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(ROWS, fanout)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, docs):
    one = docs.where("doc_id = 5")
    row = merkle.manifest(merkle.leaves(one)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert merkle.manifest(merkle.leaves(docs.limit(0))).count() == 0


def test_manifest_sql_equals_plain_tree():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars INT, chunk VARCHAR, leaf VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?, ?)", ROWS)
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=str) == plain_manifest(ROWS)


def test_numbered_rows_of_equal_keys(spark):
    df = save_table(spark.createDataFrame([("a", 1)] * 50 + [(None, 2)] * 3 + [("b", i % 2) for i in range(9)], "g string, k long"), "ties")
    got = numbered_rows(df, ["g"], ["k"], "numbered").collect()
    for g, n in (("a", 50), (None, 3), ("b", 9)):
        mine = sorted((r["pos"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(n)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert sorted(r["pos"] for r in numbered_rows(df, [], ["g", "k"], "numbered").collect()) == list(range(62))


def plain_model(rows):
    """Scores by the definition, with dictionaries; also P(word | history)."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW)) + ["</s>"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    one = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    two = Counter(p for t, h in zip(tokens, held) if not h for p in zip(["<s>", *t], t))
    n, v = sum(one.values()), len(one)

    def factors(counts):
        n_of = Counter(counts.values())
        return backoff.discounts(np.array([n_of[r] for r in range(7)]))

    d1, d2 = factors(one), factors(two)
    freed = {w: c * (1 - d1[c]) if c <= 5 else 0.0 for w, c in one.items()}
    unknown = (math.fsum(freed.values()) / n or 1 / (n + 1)) if n else 1.0
    alone = {w: (c - freed[w]) / n for w, c in one.items()}
    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    bend = {}
    for h, seen in after.items():
        left, total = math.fsum(c * (1 - d2[c]) for c in seen.values() if c <= 5), sum(seen.values())
        extra = left <= 0
        bend[h] = ((1 if extra else left) / (total + extra) / (1 - math.fsum(alone[w] for w in seen)), total + extra)

    def p(h, w):
        c = after.get(h, {}).get(w, 0)
        if c:
            return c * (d2[c] if c <= 5 else 1) / bend[h][1]
        return (bend[h][0] if h in bend else 1.0) * alone.get(w, unknown)

    scored = [(h, len(t), sum(w in one for w in t), n, math.fsum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
               math.fsum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t))) for t, h in zip(tokens, held)]
    return scored, p, list(one), list(after)


HELD = "crc32(cast(doc_id as string)) % 10 = 0"


@pytest.mark.parametrize("chunk_bytes,buckets", [(4 << 20, None), (500, 3), (1, 40)])
def test_backoff_scores_equal_plain_model(docs, chunk_bytes, buckets):
    from pyspark.sql import functions as F

    want, p, vocab, histories = plain_model(ROWS)
    for h in histories[:40]:
        assert math.fsum(p(h, w) for w in [*vocab, "\0new"]) == pytest.approx(1, abs=1e-9)
    got = backoff.score_texts(docs, F.expr(HELD), chunk_bytes=chunk_bytes, buckets=buckets).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = sorted((r[0] is None, r[0] or 0, s[1], s[0], *s[2:]) for r, s in zip(ROWS, want))
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert [g[6:] for g in got] == [pytest.approx(w[6:], rel=1e-9) for w in want]


def test_backoff_without_training_rows(docs):
    from pyspark.sql import functions as F

    rows = backoff.score_texts(docs.where("doc_id < 20"), F.lit(True)).collect()
    assert len(rows) == 20 and {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in rows} == {(0.0, 0.0, 0, 0)}
    assert backoff.score_texts(docs.limit(0), F.expr(HELD)).count() == 0


def test_discounts_fall_back_when_counts_are_few():
    good = backoff.discounts(np.array([0, 1000, 400, 220, 140, 100, 70]))
    assert ((good[1:] > 0) & (good[1:] < 1)).all()
    assert backoff.discounts(np.array([0, 3, 0, 1, 0, 0, 0])).tolist() == [1.0, 0.5, 0.75, pytest.approx(2.5 / 3), 0.875, 0.9]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    return whiten.fixed_point(df, "vec_id", "embedding")


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + rng.normal(size=12)
    base[:, 11] = base[:, 0]                                   # rank 11
    rows = [(i, [float(c) for c in r], "x") for i, r in enumerate(base)]
    rows += [(900, None, "x"), (901, [None] + [0.0] * 11, "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] * 12, "x"),
             (7, rows[7][1], "x"), (None, rows[8][1], "x")]
    v = vectors(spark, rows)
    model = whiten.fit_whitening(v, 20)
    error = whiten.identity_error(v, model)
    assert error < 1e-9 and len(model.eigenvalues) == 11 and model.n == 302
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    x = np.floor(1024 * np.array([r[1] for r in kept], np.float32).astype(float)).astype(np.int64) + 100_000
    y = (len(x) * x - x.sum(0)) / len(x)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    e, u = e[::-1][:11], u[:, ::-1][:, :11]
    assert model.eigenvalues == pytest.approx(e, rel=1e-10)
    got = whiten.whiten(v, model, error).collect()
    assert len(got) == 302 * 11
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    z = y @ u / np.sqrt(e)
    sign = np.sign((u * model.components.T).sum(axis=0))
    for i, r in enumerate(kept):
        mine = sorted(by[r[0]], key=lambda q: q["component"])[::2 if r[0] == 7 else 1]
        assert [q["whitened"] for q in mine] == pytest.approx(z[i] * sign, abs=1e-8)
        assert {q["deviation"] for q in mine} == {sum(int(c) ** 2 for c in len(x) * x[i] - x.sum(0))}
        assert [q["explained"] for q in mine] == pytest.approx(e / (y * y).sum() * len(x), rel=1e-9)


def test_whitening_of_few_vectors(spark):
    for rows in ([], [(1, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x")] * 4):
        v = vectors(spark, rows)
        model = whiten.fit_whitening(v)
        assert whiten.whiten(v, model, whiten.identity_error(v, model)).count() == 0
    with pytest.raises(Exception, match="different widths"):
        whiten.fit_whitening(vectors(spark, [(1, [1.0], "x"), (2, [1.0, 2.0], "x")]).coalesce(1))


def test_cholesky_is_triangular_and_jacobi_orthogonal():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 6))
    low = whiten.pivoted_cholesky(a @ a.T)
    assert low.shape == (9, 6) and low @ low.T == pytest.approx(a @ a.T, abs=1e-10)
    filled = sorted((low != 0).sum(axis=1))
    assert filled[:6] == [1, 2, 3, 4, 5, 6]        # triangular in the order of the pivots
    turned = whiten.jacobi_columns(low)
    gram = turned.T @ turned
    assert gram - np.diag(np.diag(gram)) == pytest.approx(np.zeros((6, 6)), abs=1e-12)
    assert np.sqrt(np.diag(gram)) == pytest.approx(np.linalg.svd(a, compute_uv=False))


def test_deviation_past_64_bits_is_an_error():
    x = np.array([[0, 1 << 40], [1 << 40, 0]])
    y = whiten.centred(x, 2, [1 << 40, 1 << 40])
    assert [sum(int(c) ** 2 for c in r) for r in y] == [2 << 80, 2 << 80]
