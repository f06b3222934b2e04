"""DuckDB counterparts of the fits: Newton steps of a logistic regression per fold as a recursive query."""

from __future__ import annotations

from workload import sql as q


def _solved(width: int, source: str, keep: str) -> str:
    """``source`` has the symmetric system h{i}_{j} (i <= j), g{i}: the solution as d{i}, by elimination and back substitution."""
    h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    for k in range(width):
        changed = [f"h{i}_{j} - {h(k, i)} / {h(k, k)} * {h(k, j)} AS h{i}_{j}" for i in range(k + 1, width) for j in range(i, width)]
        changed += [f"g{i} - {h(k, i)} / {h(k, k)} * g{k} AS g{i}" for i in range(k + 1, width)]
        if changed:
            source = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({source})"
    for k in reversed(range(width)):
        known = "".join(f" - {h(k, j)} * d{j}" for j in range(k + 1, width))
        source = f"SELECT *, (g{k}{known}) / {h(k, k)} AS d{k} FROM ({source})"
    return f"SELECT {keep} FROM ({source})"


def newton(name: str, rows: str, folds: str, features: list[str], strength: str, balanced: bool = False, steps: int = 9) -> None:
    """Steps ``{name}_scale`` (per fold) and ``{name}`` (fold, b0, b1, ...): the fit of each fold's train span."""
    width = len(features) + 1
    span = f"FROM {rows} r JOIN {folds} f ON r.date BETWEEN f.train_start AND f.train_end"
    scale = ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS sd_{c}" for c in features)
    q.step(f"{name}_scale", f"SELECT f.fold, count(*) AS n, sum(y) AS n1, {scale} {span} GROUP BY 1", rows, folds)
    weight = "CASE WHEN y = 1 THEN n / (2e0 * n1) ELSE n / (2e0 * (n - n1)) END" if balanced else "1e0"
    z = ", ".join(f"({c} - mean_{c}) / sd_{c} AS z{i}" for i, c in enumerate(features, 1))
    q.step(f"{name}_rows", f"SELECT fold, CAST(y AS DOUBLE) AS y, {weight} AS w, 1e0 AS z0, {z} FROM (SELECT f.fold, r.* {span}) JOIN {name}_scale USING (fold)", rows, folds, f"{name}_scale")
    b = [f"b{i}" for i in range(width)]
    eta = " + ".join(f"{x} * z{i}" for i, x in enumerate(b))
    ridge = lambda i: f"1e0 / {strength}" if i else "0e0"
    sums = [f"sum(w * (y - p) * z{i}) - {ridge(i)} * any_value(b{i}) AS g{i}" for i in range(width)]
    sums += [f"sum(w * p * (1 - p) * z{i} * z{j}) + {ridge(i) if i == j else '0e0'} AS h{i}_{j}" for i in range(width) for j in range(i, width)]
    kept = ", ".join(f"any_value({x}) AS {x}" for x in ("it", *b))
    system = f"""SELECT fold, {kept}, {', '.join(sums)} FROM (SELECT r.*, it, {', '.join(b)}, 1e0 / (1e0 + exp(-({eta}))) AS p
      FROM {{me}} m JOIN {name}_rows r USING (fold) WHERE it < {steps}) GROUP BY fold"""
    step = _solved(width, system, "fold, it + 1 AS it, " + ", ".join(f"b{i} + d{i} AS b{i}" for i in range(width)))
    q.step(f"{name}_steps", f"SELECT fold, 0 AS it, {', '.join(f'0e0 AS {x}' for x in b)} FROM {name}_scale UNION ALL {step}", f"{name}_scale", f"{name}_rows")
    q.step(name, f"SELECT fold, {', '.join(b)} FROM {name}_steps WHERE it = {steps}", f"{name}_steps")


def proba(name: str, features: list[str]) -> str:
    eta = " + ".join(f"b{i} * (({c} - mean_{c}) / sd_{c})" for i, c in enumerate(features, 1))
    return f"1e0 / (1e0 + exp(-(b0 + {eta})))"


METRICS = """SELECT fold, count(*) AS n_test, avg(CASE WHEN (p >= 5e-1) = (y = 1) THEN 1e0 ELSE 0e0 END) AS accuracy,
  (sum(rk * y) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS auc,
  -avg(y * ln(greatest(1e-12, least(1e0 - 1e-12, p))) + (1 - y) * ln(1e0 - greatest(1e-12, least(1e0 - 1e-12, p)))) AS logloss FROM (
  SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2e0 AS rk FROM ({scored})) GROUP BY 1"""
