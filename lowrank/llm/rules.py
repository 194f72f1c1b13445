"""Risk-controlled quality rules (operator 4), DataFrame functions only.

``text_stats`` computes the word, symbol, line and repetition counts of each
text.  ``select_cutoffs`` looks, per rule and stratum (band of word counts),
for the strictest cutoff on a fixed grid that rejects few good documents:
on the labelled holdout, ``k`` of ``n`` good documents are beyond a cutoff,
and the cutoff is certified when the exact binomial tail
``P(Bin(n, eps) <= k)`` is at most ``delta / tests`` (the Clopper-Pearson
upper bound of the false-rejection rate is then below ``eps``).  Cutoffs of
one rule and stratum are tested in fixed order from the mildest, stopping at
the first failure, which needs no further correction; Bonferroni over the
rules and strata covers the rest.  With probability ``1 - delta`` every
stratum loses at most ``eps`` per rule, so ``eps * rules`` in all.

Only (doc_id, counts) rows are joined with the labels; the texts are read
once.  The certified cutoffs are one row per stratum (``BANDS`` + 1 at most).

Defined cases: a null text has no words; a rule whose denominator is zero
reads 0; documents without words are ``base_failed``; labels that are null
or repeat count per row; without labels no cutoff is certified and only the
base rule rejects; an empty table gives an empty result; further columns are
ignored; rows repeated with one doc_id keep their own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.llm.common import read_table, save_table

BANDS = (100, 300, 1000)               # strata: n_words < 100, < 300, < 1000, more
# Rate per rule and stratum; risk over all tests.  A stratum certifies a cutoff
# from 597 good labelled documents on, if none of them is beyond it.
EPSILON, DELTA = 0.01, 0.05
BLANK = r"[\x20\x09-\x0D]+"
# rule -> (numerator, denominator, side, cutoffs from the mildest to the strictest)
RULES = {
    "symbols": ("n_symbols", "n_words", ">", (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1)),
    "dup_lines": ("n_dup_lines", "n_words", ">", (0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)),
    "repeats": ("n_repeat_words", "n_words", ">", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "short_words": ("word_chars", "n_words", "<", (2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0)),
    "long_words": ("word_chars", "n_words", ">", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
}


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text:
    sort (window hash, place), keep windows equal to a neighbour, sort the
    places and add up what each window covers."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("i")))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def places(s: Column) -> Column:
        prev = lambda x, j: (j > 0) & (F.get(s, j - 1)["h"] == x["h"])
        nxt = lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: prev(x, j) | nxt(x, j)), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    return bind(F.sort_array(windows), lambda s: bind(F.sort_array(places(s)), covered))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def stats(words: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"))

    words = lambda t: F.filter(F.split(t, BLANK, -1), lambda w: w != "")
    row = bind(text, lambda t: bind(words(t), lambda w: stats(w, t)))
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("s")).select("doc_id", "s.*")


def with_rules(stats: DataFrame) -> DataFrame:
    """Adds the stratum, base_failed and one ratio per rule."""
    band = F.lit(0)
    for edge in BANDS:
        band = band + (F.col("n_words") >= edge).cast("int")
    ratio = {f"r_{n}": F.when(F.col(d) > 0, F.col(a) / F.col(d)).otherwise(0.0) for n, (a, d, _, _) in RULES.items()}
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumns({"band": band, "base_failed": base} | ratio)


def _beyond(name: str, cutoff: Column) -> Column:
    value, side = F.col(f"r_{name}"), RULES[name][2]
    return value > cutoff if side == ">" else value < cutoff


def binomial_tail_log(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k) for k < n p (else 0, no evidence): the largest
    term by its logarithm, the smaller ones relative to it."""
    import math

    odds = p / (1 - p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    choose = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i))
    top = choose + k * math.log(p) + (n - k) * math.log(1 - p)
    down = F.aggregate(
        F.reverse(steps), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * i / ((n - i + 1) * odds)).alias("t"), (a["s"] + a["t"] * i / ((n - i + 1) * odds)).alias("s")))
    return F.when(k < n * p, top + F.log(down["s"])).otherwise(0.0)


def select_cutoffs(rows: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """(band, c_<rule>...) from labelled rows (band, r_<rule>..., quality):
    the strictest certified cutoff, null where none is."""
    import math

    good = rows.where(F.col("quality") == 1)
    hits = [F.count_if(_beyond(n, F.lit(c))).alias(f"k_{n}_{j}") for n, r in RULES.items() for j, c in enumerate(r[3])]
    counts = good.groupBy("band").agg(F.count("*").alias("n"), *hits)
    level = math.log(delta / (len(RULES) * (len(BANDS) + 1)))
    out = []
    for n, r in RULES.items():
        ok = F.array(*[binomial_tail_log(F.col(f"k_{n}_{j}"), F.col("n"), epsilon) <= level for j in range(len(r[3]))])
        # Cutoffs certified before the first failure, in the fixed order.
        passed = F.coalesce(F.nullif(F.array_position(ok, F.lit(False)), F.lit(0)) - 1, F.lit(len(r[3])).cast("long"))
        cutoffs = F.array(*[F.lit(c) for c in r[3]])
        out.append(F.when(passed > 0, F.get(cutoffs, (passed - 1).cast("int"))).alias(f"c_{n}"))
    return counts.select("band", *out)


def apply_rules(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``kept``.  ``cutoffs`` has one row per band, four by construction,
    which bounds the broadcast."""
    reject = F.lit(False)
    for n in RULES:
        reject = reject | F.coalesce(_beyond(n, F.col(f"c_{n}")), F.lit(False))
    return rows.join(F.broadcast(cutoffs), "band", "left").withColumn("kept", ~F.col("base_failed") & ~reject)


def quality_rules(docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    rows = with_rules(save_table(text_stats(docs), "rules"))
    labelled = rows.join(labels.select("doc_id", "quality"), "doc_id")
    return apply_rules(rows, select_cutoffs(labelled, epsilon, delta))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL of the query with the parameters above."""
    import math

    tests = len(RULES) * (len(BANDS) + 1)
    band = " + ".join(f"(n_words >= {b})::INT" for b in BANDS)
    ratio = ", ".join(f"CASE WHEN {d} > 0 THEN {a} / {d} ELSE 0.0 END AS r_{n}" for n, (a, d, _, _) in RULES.items())
    grid = ", ".join(f"('{n}', {j}, {c}::DOUBLE, {1 if s == '>' else -1})" for n, (_, _, s, cs) in RULES.items() for j, c in enumerate(cs))
    value = "CASE g.rule " + " ".join(f"WHEN '{n}' THEN r_{n}" for n in RULES) + " END"
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id
), s AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT *, {band} AS band, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratio} FROM s
), grid(rule, j, cutoff, side) AS (VALUES {grid}),
hit AS (
  SELECT band, g.rule, g.j, g.cutoff, g.side, count(*) AS n,
         count(*) FILTER (WHERE CASE WHEN g.side > 0 THEN {value} > g.cutoff ELSE {value} < g.cutoff END) AS k
  FROM r JOIN labels USING (doc_id) CROSS JOIN grid g WHERE quality = 1 GROUP BY ALL
), tail AS (
  SELECT *, k < n * {EPSILON} AND ln(list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({EPSILON}) + (n - i) * ln(1 - {EPSILON}))))) <= {math.log(DELTA / tests)!r} AS ok
  FROM hit
), cut AS (
  SELECT band, rule, max_by(cutoff, j) AS cutoff, any_value(side) AS side FROM (
    SELECT *, bool_and(ok) OVER (PARTITION BY band, rule ORDER BY j) AS pass FROM tail) WHERE pass GROUP BY band, rule
), bad AS (
  SELECT DISTINCT r.doc_id FROM r JOIN cut g ON r.band = g.band
  WHERE CASE WHEN g.side > 0 THEN {value} > g.cutoff ELSE {value} < g.cutoff END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM r
"""
