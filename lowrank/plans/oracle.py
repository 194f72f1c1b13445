"""Plain SQL twins of the registered plans (DuckDB dialect), run by the
correctness check on the same Parquet tables.  Column names and rounding
match ``queries.py``."""

from __future__ import annotations

from ..functions.rounding import sig_sql
from .fixed import fixed_sql

EMB = ("e AS (SELECT vec_id AS i, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS j, "
       "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
MEAN = "m AS (SELECT j, avg(v) AS mu FROM e GROUP BY j)"
CENTRED = "a AS (SELECT e.i, e.j, e.v - m.mu AS a FROM e JOIN m USING (j))"
DIMS = "SELECT DISTINCT j FROM e"
W = f"w AS ({fixed_sql('w', DIMS)})"
C = f"c AS ({fixed_sql('c', DIMS)})"
OMEGA = f"o AS ({fixed_sql('omega', DIMS)})"
CP = ("cp AS (SELECT o_custkey AS i, CAST(l_partkey AS INTEGER) AS j, sum(l_quantity) AS v "
      "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)")
N_CP = "(SELECT max(c_custkey) + 1 FROM customer)"
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_LONG = ("li AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS j, "
           f"unnest([{', '.join(LI_COLS)}]) AS v FROM lineitem)")
XA = "xa AS (SELECT a.i, w.p, sum(a.a * w.w) AS x FROM a JOIN w USING (j) GROUP BY 1, 2)"
REC = "rec AS (SELECT xa.i, c.j, sum(xa.x * c.w) AS r FROM xa JOIN c USING (p) GROUP BY 1, 2)"


def r8(expr: str, digits: int = 8) -> str:
    return f"round({expr}, {digits}) + 0.0"


def sg(expr: str, digits: int = 10) -> str:
    return f"({sig_sql(expr, digits)}) + 0.0"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _li_gram() -> str:
    """CTE ``g(r, c, g)``: Gram of the centred lineitem columns, one scan
    (one aggregate row, then unpivoted)."""
    means = ", ".join(f"avg({c}) AS m{t}" for t, c in enumerate(LI_COLS))
    centred = ", ".join(f"{c} - (SELECT m{t} FROM lm) AS a{t}" for t, c in enumerate(LI_COLS))
    n = len(LI_COLS)
    sums = ", ".join(f"sum(a{r} * a{c}) AS g{r}_{c}" for r in range(n) for c in range(n))
    unpivot = " UNION ALL ".join(f"SELECT {r} AS r, {c} AS c, g{r}_{c} AS g FROM gs"
                                 for r in range(n) for c in range(n))
    return (f"lm AS (SELECT {means} FROM lineitem), "
            f"la AS (SELECT {centred} FROM lineitem), "
            f"gs AS (SELECT {sums} FROM la), "
            f"g AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, g FROM ({unpivot}))")


def _em_k1(rounds: int = 3, trial: int = 0) -> list[str]:
    """CTEs of EM rounds with k = 1: ``c{r}(j, c, ytx)`` and ``s{r}(ss)``."""
    ctes = [EMB, MEAN, CENTRED,
            "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)",
            "dd AS (SELECT CAST(count(*) AS DOUBLE) AS d FROM m)",
            "nrm AS (SELECT sum(a * a) AS norm2 FROM a)",
            f"c0 AS (SELECT j, 1.0 / (j + {trial + 1}.0) AS c, 0.0 AS ytx FROM m)",
            "s0 AS (SELECT CAST(1.0 AS DOUBLE) AS ss)"]
    for r in range(1, rounds + 1):
        p = r - 1
        ctes += [
            f"sx{r} AS (SELECT 1.0 / ((SELECT sum(c * c) FROM c{p}) + (SELECT ss FROM s{p})) AS sx)",
            f"w{r} AS (SELECT j, c * (SELECT sx FROM sx{r}) AS w FROM c{p})",
            f"x{r} AS (SELECT a.i, sum(a.a * w{r}.w) AS x FROM a JOIN w{r} USING (j) GROUP BY a.i)",
            f"xtx{r} AS (SELECT sum(x * x) + (SELECT n FROM n) * (SELECT ss FROM s{p}) * (SELECT sx FROM sx{r}) "
            f"AS xtx FROM x{r})",
            f"c{r} AS (SELECT a.j, sum(a.a * x{r}.x) / (SELECT xtx FROM xtx{r}) AS c, sum(a.a * x{r}.x) AS ytx "
            f"FROM a JOIN x{r} USING (i) GROUP BY a.j)",
            f"s{r} AS (SELECT ((SELECT norm2 FROM nrm) + (SELECT xtx FROM xtx{r}) * (SELECT sum(c * c) FROM c{r}) "
            f"- 2 * (SELECT sum(c * ytx) FROM c{r})) / ((SELECT n FROM n) * (SELECT d FROM dd)) AS ss)",
        ]
    return ctes


def _em_rounds_sql(ctes: list[str], square: str, rounds: int = 3) -> str:
    return _with(*ctes) + "\nUNION ALL\n".join(
        f"SELECT {r} AS round, {r8(f'(SELECT ss FROM s{r})', 10)} AS ss, "
        f"{r8(f'(SELECT sqrt(sum({square})) FROM c{r})', 10)} AS c_norm" for r in range(1, rounds + 1))


def _em_k2(rounds: int = 3) -> list[str]:
    """CTEs of EM rounds with k = 2, 2 x 2 inverses written out: ``c{r}(j, c0,
    c1, y0, y1)`` and ``s{r}(ss)``."""
    ctes = [EMB, MEAN, CENTRED,
            "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)",
            "dd AS (SELECT CAST(count(*) AS DOUBLE) AS d FROM m)",
            "nrm AS (SELECT sum(a * a) AS norm2 FROM a)",
            "c0 AS (SELECT j, 1.0 / (j + 1.0) AS c0, 1.0 / (j + 3.0) AS c1, 0.0 AS y0, 0.0 AS y1 FROM m)",
            "s0 AS (SELECT CAST(1.0 AS DOUBLE) AS ss)"]
    for r in range(1, rounds + 1):
        p = r - 1
        ctes += [
            # M = C'C + ss I, Sx = M^-1 (symmetric)
            f"mm{r} AS (SELECT sum(c0 * c0) + (SELECT ss FROM s{p}) AS a00, sum(c0 * c1) AS a01, "
            f"sum(c1 * c1) + (SELECT ss FROM s{p}) AS a11 FROM c{p})",
            f"sx{r} AS (SELECT a11 / (a00 * a11 - a01 * a01) AS s00, -a01 / (a00 * a11 - a01 * a01) AS s01, "
            f"a00 / (a00 * a11 - a01 * a01) AS s11 FROM mm{r})",
            # W = C Sx'
            f"w{r} AS (SELECT j, c0 * (SELECT s00 FROM sx{r}) + c1 * (SELECT s01 FROM sx{r}) AS w0, "
            f"c0 * (SELECT s01 FROM sx{r}) + c1 * (SELECT s11 FROM sx{r}) AS w1 FROM c{p})",
            f"x{r} AS (SELECT a.i, sum(a.a * w{r}.w0) AS x0, sum(a.a * w{r}.w1) AS x1 "
            f"FROM a JOIN w{r} USING (j) GROUP BY a.i)",
            # X'X + N ss Sx and its inverse
            f"t{r} AS (SELECT sum(x0 * x0) + (SELECT n FROM n) * (SELECT ss FROM s{p}) * (SELECT s00 FROM sx{r}) AS t00, "
            f"sum(x0 * x1) + (SELECT n FROM n) * (SELECT ss FROM s{p}) * (SELECT s01 FROM sx{r}) AS t01, "
            f"sum(x1 * x1) + (SELECT n FROM n) * (SELECT ss FROM s{p}) * (SELECT s11 FROM sx{r}) AS t11 FROM x{r})",
            f"y{r} AS (SELECT a.j, sum(a.a * x{r}.x0) AS y0, sum(a.a * x{r}.x1) AS y1 "
            f"FROM a JOIN x{r} USING (i) GROUP BY a.j)",
            # C = Y'X (X'X)^-1
            f"td{r} AS (SELECT t00, t01, t11, t00 * t11 - t01 * t01 AS det FROM t{r})",
            f"c{r} AS (SELECT j, (y0 * (SELECT t11 FROM td{r}) - y1 * (SELECT t01 FROM td{r})) "
            f"/ (SELECT det FROM td{r}) AS c0, "
            f"(y1 * (SELECT t00 FROM td{r}) - y0 * (SELECT t01 FROM td{r})) / (SELECT det FROM td{r}) AS c1, "
            f"y0, y1 FROM y{r})",
            f"s{r} AS (SELECT ((SELECT norm2 FROM nrm) "
            f"+ (SELECT t00 FROM t{r}) * sum(c0 * c0) + 2 * (SELECT t01 FROM t{r}) * sum(c0 * c1) "
            f"+ (SELECT t11 FROM t{r}) * sum(c1 * c1) - 2 * sum(c0 * y0 + c1 * y1)) "
            f"/ ((SELECT n FROM n) * (SELECT d FROM dd)) AS ss FROM c{r})",
        ]
    return ctes


def _projector_sql() -> str:
    """P P' = C (C'C)^-1 C' of the k = 2 fit."""
    ctes = _em_k2() + ["q AS (SELECT sum(c0 * c0) AS q00, sum(c0 * c1) AS q01, sum(c1 * c1) AS q11 FROM c3)"]
    value = ("(a.c0 * b.c0 * q11 - (a.c0 * b.c1 + a.c1 * b.c0) * q01 + a.c1 * b.c1 * q00) / (q00 * q11 - q01 * q01)")
    return _with(*ctes) + f"SELECT a.j AS r, b.j AS c, {r8(value)} AS value FROM c3 a, c3 b, q"


def _project_sql() -> str:
    """y C (uncentred) of the k = 2 fit."""
    sums = "px AS (SELECT e.i, sum(e.v * c3.c0) AS x0, sum(e.v * c3.c1) AS x1 FROM e JOIN c3 USING (j) GROUP BY e.i)"
    return _with(*_em_k2(), sums) + " UNION ALL ".join(
        f"SELECT i AS row_id, CAST({p} AS INTEGER) AS p, {r8(f'x{p}')} AS value FROM px" for p in range(2))


def _trials_sql(trials: int = 2) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({_with(*_em_k1(trial=t))}SELECT 'embeddings' AS dataset, CAST((SELECT n FROM n) AS BIGINT) AS n_rows, "
        f"CAST((SELECT d FROM dd) AS BIGINT) AS n_cols, CAST({t} AS BIGINT) AS seed, CAST(3 AS BIGINT) AS n_iter, "
        f"{r8('(SELECT ss FROM s3)', 10)} AS ss)" for t in range(trials))


def _sketch_sql() -> str:
    """Singular values of Q'A, Q an orthonormal basis of B = A Omega with two
    columns: their squares are the eigenvalues of (B'B)^-1 (B'A)(B'A)'."""
    ctes = [EMB, MEAN, CENTRED, OMEGA,
            "b AS (SELECT a.i, sum(a.a * o.w) FILTER (o.p = 0) AS b0, sum(a.a * o.w) FILTER (o.p = 1) AS b1 "
            "FROM a JOIN o USING (j) GROUP BY a.i)",
            "bb AS (SELECT sum(b0 * b0) AS b00, sum(b0 * b1) AS b01, sum(b1 * b1) AS b11 FROM b)",
            "ba AS (SELECT a.j, sum(b.b0 * a.a) AS t0, sum(b.b1 * a.a) AS t1 FROM b JOIN a USING (i) GROUP BY a.j)",
            "mm AS (SELECT sum(t0 * t0) AS m00, sum(t0 * t1) AS m01, sum(t1 * t1) AS m11 FROM ba)",
            "tr AS (SELECT (b11 * m00 - 2 * b01 * m01 + b00 * m11) / (b00 * b11 - b01 * b01) AS t, "
            "(m00 * m11 - m01 * m01) / (b00 * b11 - b01 * b01) AS det FROM bb, mm)"]
    return _with(*ctes) + " UNION ALL ".join(
        f"SELECT CAST({p} AS INTEGER) AS p, {r8(f'sqrt((t {sign} sqrt(t * t - 4 * det)) / 2)')} AS s FROM tr"
        for p, sign in enumerate("+-"))


def _sparse_em_sql(rounds: int = 3) -> str:
    """EM rounds with k = 1 over the cells of the customer x part matrix: u =
    y w is 0 for absent rows, so sums of u and u^2 need the stored rows only,
    and the mean is folded in afterwards."""
    ctes = [CP, "z AS (SELECT i, j, v FROM cp WHERE v <> 0)",
            f"k AS (SELECT CAST({N_CP} AS DOUBLE) AS n, CAST((SELECT max(p_partkey) + 1 FROM part) AS DOUBLE) AS d)",
            "m AS (SELECT CAST(r.range AS INTEGER) AS j, coalesce(s.t, 0) / (SELECT n FROM k) AS mu "
            "FROM range((SELECT CAST(d AS BIGINT) FROM k)) r LEFT JOIN (SELECT j, sum(v) AS t FROM z GROUP BY j) s ON s.j = r.range)",
            "nrm AS (SELECT (SELECT sum(v * v) FROM z) - (SELECT n FROM k) * (SELECT sum(mu * mu) FROM m) AS norm2)",
            "c0 AS (SELECT j, 1.0 / (j + 1.0) AS c, 0.0 AS ytx FROM m)",
            "s0 AS (SELECT CAST(1.0 AS DOUBLE) AS ss)"]
    for r in range(1, rounds + 1):
        p = r - 1
        ctes += [
            f"sx{r} AS (SELECT 1.0 / ((SELECT sum(c * c) FROM c{p}) + (SELECT ss FROM s{p})) AS sx)",
            f"w{r} AS (SELECT j, c * (SELECT sx FROM sx{r}) AS w FROM c{p})",
            f"u{r} AS (SELECT z.i, sum(z.v * w) AS u FROM z JOIN w{r} USING (j) GROUP BY z.i)",
            f"xm{r} AS (SELECT sum(m.mu * w) AS xm FROM m JOIN w{r} USING (j))",
            f"xtx{r} AS (SELECT (SELECT sum(u * u) FROM u{r}) - (SELECT n FROM k) * (SELECT xm * xm FROM xm{r}) "
            f"+ (SELECT n FROM k) * (SELECT ss FROM s{p}) * (SELECT sx FROM sx{r}) AS xtx)",
            f"y{r} AS (SELECT z.j, sum(z.v * u) AS y FROM z JOIN u{r} USING (i) GROUP BY z.j)",
            f"t{r} AS (SELECT m.j, coalesce(y, 0) - m.mu * (SELECT n FROM k) * (SELECT xm FROM xm{r}) AS ytx "
            f"FROM m LEFT JOIN y{r} USING (j))",
            f"c{r} AS (SELECT j, ytx / (SELECT xtx FROM xtx{r}) AS c, ytx FROM t{r})",
            f"s{r} AS (SELECT ((SELECT norm2 FROM nrm) + (SELECT xtx FROM xtx{r}) * sum(c * c) - 2 * sum(c * ytx)) "
            f"/ ((SELECT n FROM k) * (SELECT d FROM k)) AS ss FROM c{r})",
        ]
    last = f"c{rounds}"
    return _with(*ctes) + (f"SELECT j, {r8(f'c / (SELECT sqrt(sum(c * c)) FROM {last}) * (SELECT sign(c) FROM {last} ORDER BY abs(c) DESC, j LIMIT 1)')} "
                           f"AS w FROM {last}")


def _power_chain(name: str, gram: str, steps: int) -> list[str]:
    """CTEs: power steps on ``gram(r, c, g)`` from a fixed start;
    ``{name}v(j, v)`` is the unit vector and ``{name}l(lam)`` its Rayleigh quotient."""
    ctes = [f"{name}0 AS (SELECT CAST(range AS INTEGER) AS j, 1.0 / (range + 1.0) AS v FROM range(4))"]
    for s in range(1, steps + 1):
        ctes += [f"{name}u{s} AS (SELECT g.r AS j, sum(g.g * x.v) AS u FROM {gram} g JOIN {name}{s - 1} x ON g.c = x.j GROUP BY g.r)",
                 f"{name}{s} AS (SELECT j, u / sqrt((SELECT sum(u * u) FROM {name}u{s})) AS v FROM {name}u{s})"]
    return ctes + [f"{name}v AS (SELECT j, v FROM {name}{steps})",
                   f"{name}l AS (SELECT sum(a.v * g.g * b.v) AS lam FROM {gram} g JOIN {name}v a ON g.r = a.j JOIN {name}v b ON g.c = b.j)"]


def _deflated(name: str, vector: str) -> list[str]:
    """CTE ``{name}(r, c, g)``: (I - vv') G (I - vv') for the unit vector of ``vector(j, v)``."""
    return [f"{name}i AS (SELECT a.j AS r, b.j AS c, (CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END) - a.v * b.v AS q FROM {vector} a, {vector} b)",
            f"{name}h AS (SELECT x.r, g.c, sum(x.q * g.g) AS g FROM {name}i x JOIN g ON x.c = g.r GROUP BY 1, 2)",
            f"{name} AS (SELECT h.r, x.c, sum(h.g * x.q) AS g FROM {name}h h JOIN {name}i x ON h.c = x.r GROUP BY 1, 2)"]


def _spectral_error_sql(rounds: int = 2, steps: int = 4) -> str:
    """k = 1 on lineitem: ||A (I - pp')|| against sigma_2, both by power steps
    on a deflated Gram matrix (its eigenvalues lie far apart)."""
    ctes = [_li_gram(), "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem)",
            "c0 AS (SELECT CAST(range AS INTEGER) AS j, 1.0 / (range + 1.0) AS c FROM range(4))",
            "s0 AS (SELECT CAST(1.0 AS DOUBLE) AS ss)"]
    ctes += _power_chain("top", "g", steps) + _deflated("g2", "topv") + _power_chain("second", "g2", steps)
    outs = []
    for r in range(1, rounds + 1):
        p = r - 1
        ctes += [
            f"sx{r} AS (SELECT 1.0 / ((SELECT sum(c * c) FROM c{p}) + (SELECT ss FROM s{p})) AS sx)",
            f"w{r} AS (SELECT j, c * (SELECT sx FROM sx{r}) AS w FROM c{p})",
            f"y{r} AS (SELECT g.r AS j, sum(g.g * w.w) AS y FROM g JOIN w{r} w ON g.c = w.j GROUP BY g.r)",
            f"xtx{r} AS (SELECT sum(w.w * y.y) + (SELECT n FROM n) * (SELECT ss FROM s{p}) * (SELECT sx FROM sx{r}) AS xtx "
            f"FROM w{r} w JOIN y{r} y USING (j))",
            f"c{r} AS (SELECT j, y / (SELECT xtx FROM xtx{r}) AS c, y FROM y{r})",
            f"s{r} AS (SELECT ((SELECT sum(g) FROM g WHERE r = c) + (SELECT xtx FROM xtx{r}) * sum(c * c) - 2 * sum(c * y)) "
            f"/ ((SELECT n FROM n) * 4.0) AS ss FROM c{r})",
            f"p{r} AS (SELECT j, c / (SELECT sqrt(sum(c * c)) FROM c{r}) AS v FROM c{r})",
        ]
        ctes += _deflated(f"d{r}", f"p{r}") + _power_chain(f"res{r}", f"d{r}", steps)
        outs.append(f"SELECT CAST({r} AS INTEGER) AS round, {sg(f'(SELECT ss FROM s{r})', 8)} AS ss, "
                    + r8(f"sqrt((SELECT lam FROM res{r}l)) / sqrt((SELECT lam FROM secondl)) - 1.0", 6) + " AS error")
    return _with(*ctes) + "\nUNION ALL\n".join(outs)


def _pca_top1_sql(steps: int = 3) -> str:
    ctes = [_li_gram(), "v0 AS (SELECT CAST(range AS INTEGER) AS j, CAST(1.0 AS DOUBLE) AS v FROM range(4))"]
    for s in range(1, steps + 1):
        ctes += [f"u{s} AS (SELECT g.r AS j, sum(g.g * v{s - 1}.v) AS u FROM g JOIN v{s - 1} ON g.c = v{s - 1}.j "
                 f"GROUP BY g.r)",
                 f"v{s} AS (SELECT j, u / sqrt((SELECT sum(u * u) FROM u{s})) AS v FROM u{s})"]
    last = f"v{steps}"
    ctes += [f"lam AS (SELECT sum({last}.v * gv.u) AS lam FROM {last} JOIN "
             f"(SELECT g.r AS j, sum(g.g * {last}.v) AS u FROM g JOIN {last} ON g.c = {last}.j GROUP BY g.r) gv "
             f"USING (j))",
             f"sgn AS (SELECT sign(v) AS s FROM {last} ORDER BY abs(v) DESC LIMIT 1)"]
    return (_with(*ctes) + f"SELECT j, {r8('v * (SELECT s FROM sgn)')} AS pc, "
            f"{sg('sqrt((SELECT lam FROM lam))', 9)} AS sigma1 FROM {last}")


def _power_cells_sql(steps: int = 100) -> str:
    """Power steps on A'A = Y'Y - N mu mu' over the cells, for all of A and for its
    rows without their part along p = (1, -1, 1, ...) / sqrt(d)."""
    def chain(name: str, deflated: bool) -> str:
        y = "x.z - x.p * sum(x.p * x.z) OVER ()" if deflated else "x.z"
        return (f"{name} AS (SELECT 0 AS step, j, 1.0 / (j + 1.0) AS v, CAST(0.0 AS DOUBLE) AS lam FROM m UNION ALL "
                f"SELECT step + 1, j, y / sqrt(sum(y * y) OVER ()), lam FROM (SELECT x.step, x.j, {y} AS y, "
                "sum(x.v * x.z) OVER () / sum(x.v * x.v) OVER () AS lam FROM (SELECT b.step, m.j, b.v, m.p, "
                f"coalesce(t.y, 0) - {N_CP} * m.mu * (SELECT sum(c.v * e.mu) FROM {name} c JOIN m e USING (j)) AS z "
                f"FROM {name} b JOIN m USING (j) LEFT JOIN (SELECT z.j, sum(z.v * u.u) AS y FROM z JOIN "
                f"(SELECT z.i, sum(z.v * a.v) AS u FROM {name} a JOIN z USING (j) GROUP BY z.i) u USING (i) GROUP BY z.j) t ON t.j = m.j "
                f"WHERE b.step < {steps}) x))")

    m = (f"m AS (SELECT CAST(r.range AS INTEGER) AS j, coalesce(s.t, 0) / {N_CP} AS mu, "
         "(1.0 - 2.0 * (r.range % 2)) / sqrt(count(*) OVER ()) AS p FROM range((SELECT max(p_partkey) + 1 FROM part)) r "
         "LEFT JOIN (SELECT j, sum(v) AS t FROM z GROUP BY j) s ON s.j = r.range)")
    values = ", ".join(f"{sg(f'sqrt((SELECT max(lam) FROM {t} WHERE step = {steps}))', 8)} AS {n}" for t, n in (("a", "sigma1"), ("b", "residual")))
    return "WITH RECURSIVE " + ",\n".join([CP, "z AS (SELECT i, j, v FROM cp WHERE v <> 0)", m, chain("a", False), chain("b", True)]) + f"\nSELECT {values}"


def _em_converged_sql() -> str:
    """EM rounds with k = 1 on the Gram matrix until the noise variance changes by at most 1e-5."""
    ctes = [EMB, MEAN, CENTRED, "g AS (SELECT a.j AS r, b.j AS c, sum(a.a * b.a) AS g FROM a JOIN a b USING (i) GROUP BY 1, 2)",
            "k AS (SELECT CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS n, CAST((SELECT count(*) FROM m) AS DOUBLE) AS d, "
            "(SELECT sum(g) FROM g WHERE r = c) AS tr)",
            "em AS (SELECT 0 AS round, j, 1.0 / (j + 1.0) AS c, CAST(1.0 AS DOUBLE) AS ss, CAST('inf' AS DOUBLE) AS rel FROM m UNION ALL "
            "SELECT round + 1, j, c, ss, CASE WHEN round = 0 THEN CAST('inf' AS DOUBLE) ELSE abs(1 - ss / old) END FROM ("
            "SELECT round, j, c, old, (k.tr + xtx * sum(c * c) OVER () - 2 * sum(c * y) OVER ()) / (k.n * k.d) AS ss FROM ("
            "SELECT round, j, y / xtx AS c, y, xtx, old FROM (SELECT round, j, y, old, sum(w * y) OVER () + k.n * old * sx AS xtx FROM ("
            "SELECT g.r AS j, any_value(round) AS round, any_value(ss) AS old, any_value(sx) AS sx, sum(g.g * e.c * sx) AS y, "
            "max(CASE WHEN g.r = e.j THEN e.c * sx END) AS w FROM (SELECT *, 1.0 / (sum(c * c) OVER () + ss) AS sx FROM em "
            "WHERE rel > 1e-5 AND round < 300) e JOIN g ON g.c = e.j GROUP BY g.r), k)), k))"]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT CAST(round AS INTEGER) AS rounds, "
            + r8("max(ss)", 10) + " AS ss, max(rel) <= 1e-5 AS converged FROM em WHERE round = (SELECT max(round) FROM em) GROUP BY round")


EMB_ROWS = ("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, CAST(len(embedding) AS INTEGER) AS width, "
            + r8("list_sum(CAST(embedding AS DOUBLE[]))") + " AS row_sum FROM embeddings")
CP_CELLS = _with(CP) + f"SELECT i, j, {r8('v', 6)} AS v FROM cp WHERE v <> 0"

ORACLE = {
    "col_mean_dense": _with(EMB) + f"SELECT j, {r8('avg(v)', 10)} AS mean FROM e GROUP BY j",
    "col_mean_sparse": _with(CP, "t AS (SELECT j, sum(v) AS t FROM cp WHERE v <> 0 GROUP BY j)")
    + f"SELECT CAST(r.range AS INTEGER) AS j, {r8(f'coalesce(t.t, 0) / {N_CP}', 10)} AS mean "
    "FROM range((SELECT max(p_partkey) + 1 FROM part)) r LEFT JOIN t ON t.j = r.range",
    "frob2_dense": _with(EMB, MEAN, CENTRED) + f"SELECT {r8('sum(a * a)')} AS norm2 FROM a",
    "frob2_sparse": _with(CP, "t AS (SELECT j, sum(v) AS t, sum(v * v) AS sq FROM cp WHERE v <> 0 GROUP BY j)")
    + f"SELECT {sg(f'sum(sq - t * t / {N_CP})')} AS norm2 FROM t",
    "center_rows": _with(EMB, MEAN, CENTRED) + f"SELECT i AS row_id, j, {r8('a')} AS value FROM a",
    "nonzero_filter": _with(LI_LONG) + f"SELECT j, count(*) AS nnz, {sg('sum(v)')} AS total FROM li "
    "WHERE v <> 0 AND j < 4 GROUP BY j",
    "coo_build": _with(CP) + f"SELECT i, j, {r8('v', 6)} AS v FROM cp",
    "coo_to_rows": _with(CP) + "SELECT i, CAST(count(*) AS INTEGER) AS nnz, min(j) AS min_j, max(j) AS max_j, "
    f"{r8('sum(v)', 6)} AS row_sum FROM cp WHERE v <> 0 GROUP BY i",
    "rows_to_coo": _with(CP) + "SELECT CAST(i AS VARCHAR) || ',' || CAST(j AS VARCHAR) || ',' || CAST(v AS VARCHAR) "
    "AS line FROM cp WHERE v <> 0",
    "coo_text_roundtrip": _with(CP) + f"SELECT i, j, {r8('v', 6)} AS v FROM cp WHERE v <> 0",
    "lil_text": _with(CP, "t AS (SELECT i, string_agg(CAST(j AS VARCHAR) || ':' || CAST(v AS VARCHAR), ',' ORDER BY j) AS s "
                          "FROM cp WHERE v <> 0 GROUP BY i)")
    + "SELECT r.range AS i, '{' || coalesce(t.s, '') || '}' AS line "
    f"FROM range({N_CP}) r LEFT JOIN t ON t.i = r.range",
    "dense_text": "SELECT " + " || ".join(f"CAST({c} AS VARCHAR) || ' '" for c in LI_COLS) + " AS line FROM lineitem",
    "dense_text_parse": _with(LI_LONG) + f"SELECT j, {sg('sum(v)')} AS total FROM li GROUP BY j",
    "project_fixed": _with(EMB, W) + f"SELECT e.i AS row_id, w.p, {r8('sum(e.v * w.w)')} AS x "
    "FROM e JOIN w USING (j) GROUP BY e.i, w.p",
    "back_project": _with(EMB, W, C, "x AS (SELECT e.i, w.p, sum(e.v * w.w) AS x FROM e JOIN w USING (j) "
                                     "GROUP BY 1, 2)")
    + f"SELECT x.i AS row_id, c.j, {r8('sum(x.x * c.w)')} AS value FROM x JOIN c USING (p) GROUP BY x.i, c.j",
    "residual_rows": _with(EMB, MEAN, CENTRED, W, C, XA, REC)
    + f"SELECT a.i AS row_id, a.j, {r8('a.a - rec.r')} AS value FROM a JOIN rec ON a.i = rec.i AND a.j = rec.j",
    "reconstruct_fixed": _with(EMB, MEAN, CENTRED, W, XA,
                               "rw AS (SELECT xa.i, w.j, sum(xa.x * w.w) AS r FROM xa JOIN w USING (p) "
                               "GROUP BY 1, 2)")
    + f"SELECT i AS row_id, j, {r8('r')} AS value FROM rw",
    "project_relational": _with(EMB, W) + f"SELECT e.i AS row_id, w.p, {r8('sum(e.v * w.w)')} AS x "
    "FROM e JOIN w USING (j) WHERE e.v <> 0 AND w.w <> 0 GROUP BY e.i, w.p",
    "center_entries_sparse": _with(CP, f"cm AS (SELECT j, sum(v) / {N_CP} AS mu FROM cp GROUP BY j)")
    + f"SELECT cp.i, cp.j, {r8('cp.v - cm.mu')} AS value FROM cp JOIN cm USING (j) WHERE cp.v <> 0",
    "col_abs_max": _with(EMB, MEAN, CENTRED)
    + f"SELECT {r8('max(s)')} AS abs_norm FROM (SELECT j, sum(abs(a)) AS s FROM a GROUP BY j)",
    "em_stats_fixed": _with(EMB, MEAN, CENTRED, W, XA)
    + f"SELECT 'xtx' AS stat, x1.p AS r, x2.p AS c, {r8('sum(x1.x * x2.x)')} AS value "
    "FROM xa x1 JOIN xa x2 ON x1.i = x2.i GROUP BY 2, 3 UNION ALL "
    f"SELECT 'ytx' AS stat, a.j AS r, xa.p AS c, {r8('sum(a.a * xa.x)')} AS value "
    "FROM a JOIN xa ON a.i = xa.i GROUP BY 2, 3",
    "cross_term_fixed": _with(EMB, MEAN, CENTRED, W, C, XA,
                              "ac AS (SELECT a.i, c.p, sum(a.a * c.w) AS z FROM a JOIN c USING (j) GROUP BY 1, 2)")
    + f"SELECT {sg('sum(xa.x * ac.z)')} AS cross_term FROM xa JOIN ac ON xa.i = ac.i AND xa.p = ac.p",
    "qta_fixed": _with(EMB, MEAN, CENTRED, OMEGA,
                       "b AS (SELECT a.i, o.p, sum(a.a * o.w) AS b FROM a JOIN o USING (j) GROUP BY 1, 2)")
    + f"SELECT b.p, a.j, {r8('sum(b.b * a.a)')} AS value FROM b JOIN a ON a.i = b.i GROUP BY 1, 2",
    "col_abs_norm": _with(EMB, MEAN, CENTRED) + f"SELECT j, {r8('sum(abs(a))')} AS abs_sum FROM a GROUP BY j",
    "l1_error_fixed": _with(EMB, MEAN, CENTRED, W, C, XA, REC)
    + "SELECT " + r8("(SELECT max(s) FROM (SELECT a.j, sum(abs(rec.r - a.a)) AS s FROM a JOIN rec "
                     "ON a.i = rec.i AND a.j = rec.j GROUP BY a.j)) / "
                     "(SELECT max(s) FROM (SELECT j, sum(abs(a)) AS s FROM a GROUP BY j))", 10) + " AS l1_error",
    "row_sample": "SELECT vec_id AS row_id, "
    + r8("list_sum(CAST(embedding AS DOUBLE[]))")
    + " AS row_sum FROM embeddings WHERE CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) "
    "/ 4294967296.0 < 0.3",
    "gram_embeddings": _with(EMB, MEAN, CENTRED)
    + f"SELECT a1.j AS r, a2.j AS c, {r8('sum(a1.a * a2.a)')} AS g FROM a a1 JOIN a a2 ON a1.i = a2.i GROUP BY 1, 2",
    "gram_lineitem": _with(_li_gram()) + f"SELECT r, c, {sg('g', 9)} AS g FROM g",
    "pca_top1": _pca_top1_sql(),
    "em_k1_3rounds": _em_rounds_sql(_em_k1(), "c * c"),
    "em_k2_3rounds": _em_rounds_sql(_em_k2(), "c0 * c0 + c1 * c1"),
    "sketch_svd": _sketch_sql(),
    "ppca_fit": _projector_sql(),
    "ppca_project": _project_sql(),
    "spectral_error": _spectral_error_sql(),
    "sparse_ppca_fit": _sparse_em_sql(),
    "ppca_trials": _trials_sql(),
    "segmented_rows": _with(CP, "s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY i) > 32 THEN j // 32 ELSE -1 END AS segment "
                                "FROM cp WHERE v <> 0)")
    + "SELECT i, CAST(segment AS INTEGER) AS segment, CAST(count(*) AS INTEGER) AS nnz, min(j) AS min_j, max(j) AS max_j, "
    f"{r8('sum(v)', 6)} AS row_sum FROM s GROUP BY i, segment",
    "segmented_fit": _sparse_em_sql(),
    "wide_spectrum": _power_cells_sql(),
    "em_until_converged": _em_converged_sql(),
    "dense_file_read": EMB_ROWS,
    "dense_file_convert": EMB_ROWS,
    "coo_file_read": CP_CELLS,
    "coo_file_convert": CP_CELLS,
    "rejected_lines": "".join(
        f"{join}SELECT '{name}' AS format, CASE WHEN l_returnflag = 'R' THEN '{number}' ELSE '{width}' END AS reason, count(*) AS n_lines "
        "FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY 1, 2"
        for join, name, number, width in (("", "dense", "a value is not a number", "row of width 3, expected 4"),
                                          (" UNION ALL ", "coo", "a field is not a number", "2 fields, expected 3"))),
    "saved_projection": _project_sql(),
    "run_log": f"SELECT user_id, count(*) AS n_iter, {r8('avg(value)', 6)} AS avg_iter_s FROM events GROUP BY user_id",
    "mllib_rows": EMB_ROWS,
    "spread_rows": f"SELECT count(*) AS n_rows, {r8('sum(list_sum(CAST(embedding AS DOUBLE[])))', 6)} AS total, 3 AS partitions FROM embeddings",
    "trial_summary": f"SELECT user_id, count(*) AS n_runs, {r8('avg(value)')} AS avg_s, "
    f"{r8('var_samp(value)', 4)} AS var_s FROM events GROUP BY user_id",
}
