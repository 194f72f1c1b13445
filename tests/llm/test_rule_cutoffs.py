"""Certified cutoffs of the quality rules against exact binomial sums."""

import math
import random

from lowrank.llm import rules
from lowrank.llm.common import save_table


def plain_cutoff(values, name, epsilon, level):
    """Strictest cutoff before the first in the fixed order that is not certified."""
    _, _, side, cutoffs = rules.RULES[name]
    n, best = len(values), None
    for c in cutoffs:
        k = sum(v > c if side == ">" else v < c for v in values)
        tail = math.fsum(math.comb(n, i) * epsilon ** i * (1 - epsilon) ** (n - i) for i in range(k + 1))
        if k >= n * epsilon or tail > level:
            break
        best = c
    return best


def test_cutoffs_equal_exact_binomial_bounds(spark):
    epsilon, r = rules.EPSILON, random.Random(8)
    names = list(rules.RULES)
    rows = []
    for band, n in ((0, 100), (1, 700), (2, 1500), (3, 5)):
        for _ in range(n):
            good = r.random() < 0.9
            spread = 0.25 if good else 3
            rows.append((band, int(good) if r.random() < 0.98 else None,
                         *(4.6 + r.gauss(0, 0.3 * spread) if "words" in x else max(0.0, r.gauss(-0.2, spread)) for x in names)))
    rows += rows[:50]                                              # repeated rows count each
    df = spark.createDataFrame(rows, "band int, quality int, " + ", ".join(f"r_{x} double" for x in names))
    cutoffs = save_table(rules.select_cutoffs(df, epsilon), "cutoffs")
    got = {x["band"]: x for x in cutoffs.collect()}
    level = rules.DELTA / (len(names) * (len(rules.BANDS) + 1))
    certified = 0
    for band in range(4):
        for i, name in enumerate(names):
            want = plain_cutoff([x[2 + i] for x in rows if x[0] == band and x[1] == 1], name, epsilon, level)
            assert got[band][f"c_{name}"] == want
            certified += want is not None
    assert certified >= 5
    kept = rules.apply_rules(df.selectExpr("*", "false as base_failed"), cutoffs).collect()
    for x in kept:
        beyond = any(c is not None and (x[f"r_{n}"] > c if rules.RULES[n][2] == ">" else x[f"r_{n}"] < c)
                     for n in names for c in [got[x["band"]][f"c_{n}"]])
        assert x["kept"] == (not beyond)


def test_no_labels_certify_nothing(spark):
    names = list(rules.RULES)
    df = spark.createDataFrame([], "band int, quality int, " + ", ".join(f"r_{x} double" for x in names))
    assert rules.select_cutoffs(df).count() == 0
