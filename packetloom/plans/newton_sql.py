"""Newton rounds of a logistic regression in SQL: what the fitted reports must equal."""

from __future__ import annotations


def margin_sql(x: str, b: str = "b") -> str:
    return f"1 / (1 + exp(-list_inner_product({x}, {b})))"


def _solved(matrix: str, size: int) -> str:
    """Gauss-Jordan elimination over the rows [h_1 .. h_size, g] of a matrix; the last column is then the solution."""
    k = "e[1][1]::INT"
    step = (f"list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) "
            f"ELSE list_transform(r, lambda v, c: v - r[{k}] * m[{k}][c] / m[{k}][{k}]) END)")
    turns = f"list_transform(range(1, {size + 1}), lambda k: [[k::DOUBLE]])"
    return f"list_transform(list_reduce(list_prepend({matrix}, {turns}), lambda m, e: {step}), lambda r: r[{size + 1}])"


def fit_sql(source: str, features: int, balanced: bool, rounds: int = 12) -> list[str]:
    """Tables up to {source}_fit (b): coefficients, then the intercept, after ``rounds`` rounds over (x, y) of ``source``.

    x ends in 1. The penalty is |coefficients|^2 / 2, the intercept has none.
    """
    n = features + 1
    weight = f"(SELECT count(*) FROM {source}) / (2 * (SELECT count(*) FROM {source} s WHERE s.y = t.y))" if balanced else "1.0::DOUBLE"
    parts = [f"{source}_w AS MATERIALIZED (SELECT t.x, t.y, c.w FROM {source} t JOIN (SELECT DISTINCT y, {weight} AS w FROM {source} t) c USING (y))",
             f"{source}_b0 AS (SELECT list_transform(range({n}), lambda i: 0.0::DOUBLE) AS b)"]
    for k in range(rounds):
        parts.append(f"""{source}_p{k} AS MATERIALIZED (SELECT x, y, w, {margin_sql('x')} AS p FROM {source}_w, {source}_b{k})""")
        parts.append(f"""{source}_h{k} AS MATERIALIZED (SELECT i, list(h ORDER BY j) AS row FROM (
  SELECT i, j, sum(w * p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i < {n} THEN 1 ELSE 0 END AS h
  FROM {source}_p{k}, range(1, {n + 1}) a(i), range(1, {n + 1}) c(j) GROUP BY i, j) GROUP BY i)""")
        parts.append(f"""{source}_g{k} AS MATERIALIZED (SELECT i, sum(w * (p - y) * x[i]) + CASE WHEN i < {n} THEN any_value(b[i]) ELSE 0 END AS g
  FROM {source}_p{k}, {source}_b{k}, range(1, {n + 1}) a(i) GROUP BY i)""")
        parts.append(f"""{source}_b{k + 1} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v - s[i]) AS b FROM {source}_b{k}, (
  SELECT {_solved('list(list_append(row, g) ORDER BY i)', n)} AS s FROM {source}_h{k} JOIN {source}_g{k} USING (i)))""")
    parts.append(f"{source}_fit AS (SELECT b FROM {source}_b{rounds})")
    return parts
