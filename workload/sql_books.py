"""DuckDB counterparts of the portfolio steps, chained after the alpha step."""

from __future__ import annotations

from workload import sql as q

BOOK = "PARTITION BY portfolio_id, date"
q.step("book", "SELECT 'main' AS portfolio_id, date, symbol, score FROM alpha WHERE score > 0", "alpha")


def select_n(source: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER ({BOOK} ORDER BY score DESC, symbol) AS position FROM {source})
      WHERE position <= {n}"""


def select_quantile(source: str, n: int, share: str) -> str:
    return f"""SELECT * EXCLUDE size FROM (SELECT *, row_number() OVER ({BOOK} ORDER BY score DESC, symbol) AS position,
      count(*) OVER ({BOOK}) AS size FROM {source}) WHERE position <= least({n}, greatest(1, ceil(size * {share})))"""


def raw(source: str, target: str, least: int, cash: bool = True) -> str:
    t = f"(CASE WHEN count(*) OVER ({BOOK}) < {least} THEN {target} * count(*) OVER ({BOOK}) / {float(least)}::DOUBLE ELSE {target} END)" if cash else target
    return f"""SELECT portfolio_id, date, symbol, score, score * ({t} / sum(score) OVER ({BOOK})) AS weight FROM {source}"""


def cap(source: str, limit: str) -> str:
    return f"""SELECT portfolio_id, date, symbol, score,
        CASE WHEN total <= 0 OR weight <= 0 THEN weight WHEN fr IS NULL OR rk < fr THEN {limit} WHEN fr = 1 THEN weight ELSE weight * fs END AS weight
      FROM (SELECT *, min(CASE WHEN fits THEN rk END) OVER ({BOOK}) AS fr,
              max(CASE WHEN fits AND rk = fmin THEN scale END) OVER ({BOOK}) AS fs
            FROM (SELECT *, min(CASE WHEN fits THEN rk END) OVER ({BOOK}) AS fmin FROM (
              SELECT *, weight * scale <= {limit} AS fits FROM (
                SELECT *, CASE WHEN rest > 0 THEN (total - (rk - 1) * {limit}) / rest END AS scale FROM (
                  SELECT *, row_number() OVER ({BOOK} ORDER BY weight DESC, symbol) AS rk, sum(weight) OVER ({BOOK}) AS total,
                    sum(weight) OVER ({BOOK} ORDER BY weight DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                  FROM {source})))))"""


def refill(source: str, target: str) -> str:
    return f"""SELECT portfolio_id, date, symbol, score, CASE WHEN s > 0 AND s < {target} - 1e-12 THEN weight * ({target} / s) ELSE weight END AS weight
      FROM (SELECT *, sum(weight) OVER ({BOOK}) AS s FROM {source})"""


def floor(source: str, least: str) -> str:
    return f"""SELECT portfolio_id, date, symbol, score, CASE WHEN a - k > 0 THEN weight * (a / k) ELSE weight END AS weight FROM (
      SELECT *, sum(weight) OVER ({BOOK}) AS a, sum(CASE WHEN weight >= {least} THEN weight END) OVER ({BOOK}) AS k FROM {source})
      WHERE weight >= {least}"""


q.step("top10", select_n("book", 10), "book")
q.step("topq", select_quantile("book", 8, "4e-1"), "book")
q.step("w_raw", raw("top10", "1e0", 5), "top10")
q.step("w_cap", cap("w_raw", "15e-2"), "w_raw")
q.step("w_short", raw("topq", "1e0", 12, cash=False), "topq")
q.step("w_short_cap", cap("w_short", "12e-2"), "w_short")
q.step("w_fill0", refill("w_short_cap", "1e0"), "w_short_cap")
q.step("w_fill", cap("w_fill0", "12e-2"), "w_fill0")
q.step("w_min0", floor("w_cap", "8e-2"), "w_cap")
q.step("w_min", cap("w_min0", "15e-2"), "w_min0")
q.step("w_old", "SELECT portfolio_id, next_trading_date AS date, symbol, weight FROM w_cap JOIN cal USING (date) WHERE next_trading_date IS NOT NULL",
       "w_cap", "cal")
q.step("w_both", """SELECT coalesce(n.portfolio_id, o.portfolio_id) AS portfolio_id, coalesce(n.date, o.date) AS date, coalesce(n.symbol, o.symbol) AS symbol,
  coalesce(n.weight, 0e0) AS w_new, coalesce(o.weight, 0e0) AS w_old, n.weight IS NOT NULL AS is_new, coalesce(n.score, 0e0) AS score
  FROM w_cap n FULL JOIN w_old o ON n.portfolio_id = o.portfolio_id AND n.date = o.date AND n.symbol = o.symbol""", "w_cap", "w_old")
q.step("w_band0", """SELECT portfolio_id, date, symbol, score,
  CASE WHEN w_old <> 0 AND w_new <> 0 AND abs(w_new - w_old) < 2e-2 THEN w_old ELSE w_new END AS weight FROM w_both WHERE is_new""", "w_both")
q.step("w_band1", f"""SELECT portfolio_id, date, symbol, score, CASE WHEN s > 0 THEN weight * (least(1e0, s) / s) ELSE weight END AS weight
  FROM (SELECT *, sum(weight) OVER ({BOOK}) AS s FROM w_band0)""", "w_band0")
q.step("w_band", cap("w_band1", "15e-2"), "w_band1")
q.step("w_lim0", f"""SELECT *, sum(abs(w_new - w_old)) OVER ({BOOK}) AS t FROM w_both""", "w_both")
q.step("w_lim1", """SELECT portfolio_id, date, symbol, score, t > 313701593871e-12 AS hit,
  CASE WHEN t > 313701593871e-12 THEN greatest(w_old + (313701593871e-12 / t) * (w_new - w_old), 0e0) ELSE w_new END AS weight FROM w_lim0""", "w_lim0")
q.step("w_lim2", "SELECT * FROM w_lim1 WHERE weight > 0", "w_lim1")
q.step("w_lim3", cap("w_lim2", "15e-2"), "w_lim2")
q.step("w_lim", """SELECT a.portfolio_id, a.date, a.symbol, CASE WHEN b.hit THEN a.weight ELSE b.weight END AS weight
  FROM w_lim3 a JOIN w_lim2 b USING (portfolio_id, date, symbol)""", "w_lim3", "w_lim2")


def equity(name: str, weights: str, cal: str) -> None:
    """Steps ``{name}_ret``, ``{name}_nav``, ``{name}_path``: portfolio return, value and drawdown by date."""
    q.step(f"{name}_ret", f"""SELECT w.portfolio_id, f.date, sum(w.weight * f.ret1) AS ret FROM {weights} w JOIN cal c ON c.date = w.date
      JOIN feats f ON f.symbol = w.symbol AND f.date = c.next_trading_date WHERE w.weight > 0 AND f.ret1 IS NOT NULL GROUP BY 1, 2""",
           weights, "cal", "feats")
    q.step(f"{name}_nav", f"""SELECT 'main' AS portfolio_id, c.date, coalesce(r.ret, 0e0) AS ret,
      1e5 * product(1e0 + coalesce(r.ret, 0e0)) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS nav
      FROM {cal} c LEFT JOIN {name}_ret r USING (date)""", cal, f"{name}_ret")
    q.step(f"{name}_path", f"""SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS change,
      max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {name}_nav""", f"{name}_nav")


def stats(name: str, weights: str, dates: str) -> str:
    return f"""SELECT 'main' AS portfolio_id, round(arg_min(nav, date), 4) AS initial_value, round(arg_max(nav, date), 4) AS final_value,
      round(arg_max(nav, date) / arg_min(nav, date) - 1, 6) AS total_return, round(avg(change) * 252, 6) AS annualised_return,
      round(stddev_samp(change) * sqrt(252e0), 6) AS annualised_vol, round(avg(change) * 252 / (stddev_samp(change) * sqrt(252e0)), 6) AS sharpe_ratio,
      round(min(nav / peak - 1), 6) AS max_drawdown, count(change) AS n_trading_days,
      (SELECT count(*) FROM {dates}) AS n_rebalances,
      round((SELECT count(*) FROM {weights} WHERE weight > 0) / (SELECT count(*) FROM {dates}), 6) AS avg_positions FROM {name}_path"""


q.step("rule_dates", "SELECT DISTINCT date FROM alpha", "alpha")
equity("rule", "w_cap", "cal")

# The full run: live regimes on the panel from the ready date, default settings for the universe.
_cols = ", ".join(f"f.{c}" for c in ("mom63", "dev20", "rv20_z", "rv60", "rv20"))
q.step("run_grid", """SELECT c.date, u.symbol, coalesce(f.n, 0) AS n, f.mom63, f.dev20, f.rv20_z, f.rv60, f.rv20, f.normalized_slope, f.max_dd_90, f.trend_gap
  FROM (SELECT date FROM cal WHERE date >= (SELECT d FROM ready)) c JOIN (SELECT DISTINCT symbol FROM feats) u ON TRUE
  LEFT JOIN feats f ON f.symbol = u.symbol AND f.date <= c.date AND (f.next_date > c.date OR f.next_date IS NULL)""", "cal", "ready", "feats")
q.step("run_msig", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM mraw WHERE n >= 30 AND date >= (SELECT d FROM ready)", "mraw", "ready")
q.step("run_mstate", q.fold("run_msig", 2, {0: 0, 1: 1, 2: 2, 3: 3}, "6e-1", 7, None), "run_msig")
q.step("run_market", f"""SELECT c.date, coalesce({q.M_LABEL.format(c='s.label')}, 'calm_range') AS label, coalesce(s.conf, 0e0) AS confidence
  FROM (SELECT date FROM cal WHERE date >= (SELECT d FROM ready)) c LEFT JOIN run_mstate s USING (date)""", "cal", "ready", "run_mstate")
q.step("run_sig0", f"""SELECT p.symbol, p.date, {q.SIGNALS}, m.label IN ('stress', 'crisis') AS market_stressed
  FROM run_grid p JOIN run_market m USING (date)""", "run_grid", "run_market")
q.step("run_sig", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, {q._s_raw()} FROM run_sig0", "run_sig0")
q.step("run_state", q.fold("run_sig", 2, {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}, "6e-1", 7, 3), "run_sig")
q.step("run_stock", f"SELECT symbol, date, {q.S_LABEL.format(c='label')} AS label, least(1e0, greatest(0e0, conf)) AS confidence FROM run_state", "run_state")
q.step("run_models", q.models("run_grid"), "run_grid")
q.step("run_in", """SELECT m.*, s.label AS stock_label, s.confidence AS stock_conf, k.label AS market_label
  FROM run_models m JOIN run_stock s USING (symbol, date) JOIN run_market k USING (date)""", "run_models", "run_stock", "run_market")
q.step("run_routed", q.combined("run_in"), "run_in")
q.step("run_alpha", f"SELECT *, {q.unit_rank('combined_score', 'date', '0e0')} AS score FROM run_routed", "run_routed")
q.step("run_book", "SELECT 'main' AS portfolio_id, date, symbol, score FROM run_alpha WHERE score > 0", "run_alpha")
q.step("run_top", select_n("run_book", 25), "run_book")
q.step("run_raw", raw("run_top", "1e0", 5), "run_top")
q.step("run_weights", cap("run_raw", "8e-2"), "run_raw")
q.step("run_dates", "SELECT date FROM cal WHERE date >= (SELECT d FROM ready)", "cal", "ready")
equity("run", "run_weights", "cal")


def _capped(book: str, limit: str) -> str:
    """The capped book (a list of s, w) of ``book``: sorted by weight, then the first position that fits sets the scale."""
    down = f"list_sort(list_transform(list_filter({book}, lambda x: x.w > 0), lambda x: {{'k': -x.w, 's': x.s}}))"
    return f"""SELECT * EXCLUDE (down, total, scales, first), CASE WHEN total <= 0 THEN {book} ELSE list_transform(down, lambda x, n:
          {{'s': x.s, 'w': CASE WHEN first = 0 OR n < first THEN {limit} WHEN first = 1 THEN -x.k ELSE -x.k * scales[first] END}}) END AS out
        FROM (SELECT *, coalesce(list_position(list_transform(down, lambda x, n: -x.k * scales[n] <= {limit}), true), 0) AS first
          FROM (SELECT *, list_transform(down, lambda x, n: (total - (n - 1) * {limit}) / list_sum(list_transform(down[n:], lambda y: -y.k))) AS scales
            FROM (SELECT *, {down} AS down, coalesce(list_sum(list_transform({book}, lambda x: x.w)), 0e0) AS total FROM ({{source}}))))"""


def path(name: str, targets: str, dates: str, limit: str, gross: str = "1e0", band: str | None = None, turnover: str | None = None) -> None:
    """Steps ``{name}_days`` (a date's targets as a list) and ``{name}`` (portfolio_id, date, symbol, weight): the book carried from date to date."""
    q.step(f"{name}_days", f"""SELECT d.date, row_number() OVER (ORDER BY d.date) AS i, coalesce(t.book, []) AS target
      FROM (SELECT DISTINCT date FROM {dates}) d LEFT JOIN (SELECT date, list({{'s': symbol, 'w': weight}} ORDER BY symbol) AS book FROM {targets} GROUP BY 1) t ON t.date = d.date""", targets, dates)
    got = lambda m, key: f"coalesce({m}[{key}], 0e0)"
    maps = "map_from_entries(list_transform(book, lambda x: (x.s, x.w))) AS old, map_from_entries(list_transform(target, lambda x: (x.s, x.w))) AS new"
    source = f"SELECT d.i, d.date, p.book, d.target, {maps.replace('target', 'd.target').replace('book', 'p.book')} FROM {{me}} p JOIN {name}_days d ON d.i = p.i + 1"
    if band is not None:
        old = got("old", "x.s")
        mixed = f"list_transform(target, lambda x: {{'s': x.s, 'w': CASE WHEN {old} <> 0 AND x.w <> 0 AND abs(x.w - {old}) < {band} THEN {old} ELSE x.w END}})"
        source = f"SELECT *, {mixed} AS mixed FROM ({source})"
        source = f"SELECT *, coalesce(list_sum(list_transform(mixed, lambda x: x.w)), 0e0) AS s FROM ({source})"
        source = f"SELECT *, CASE WHEN s > 0 THEN list_transform(mixed, lambda x: {{'s': x.s, 'w': x.w * (least({gross}, s) / s)}}) ELSE mixed END AS scaled FROM ({source})"
        source = _capped("scaled", limit).replace("{source}", source)
    else:
        names = "list_sort(list_distinct(list_concat(map_keys(old), map_keys(new))))"
        source = f"SELECT *, {names} AS names FROM ({source})"
        source = f"SELECT *, coalesce(list_sum(list_transform(names, lambda x: abs({got('new', 'x')} - {got('old', 'x')}))), 0e0) AS traded FROM ({source})"
        moved = f"greatest({got('old', 'x')} + {turnover} / traded * ({got('new', 'x')} - {got('old', 'x')}), 0e0)"
        source = f"SELECT *, CASE WHEN traded > {turnover} THEN list_filter(list_transform(names, lambda x: {{'s': x, 'w': {moved}}}), lambda x: x.w > 0) ELSE target END AS moved FROM ({source})"
        source = _capped("moved", limit).replace("{source}", source)
        source = f"SELECT * REPLACE (CASE WHEN traded > {turnover} THEN out ELSE target END AS out) FROM ({source})"
    q.step(f"{name}_scan", f"""SELECT CAST(0 AS BIGINT) AS i, NULL::DATE AS date, CAST([] AS STRUCT(s VARCHAR, w DOUBLE)[]) AS book
      UNION ALL SELECT i, date, CASE WHEN len(book) = 0 THEN target ELSE out END AS book FROM ({source})""", f"{name}_days")
    q.step(name, f"SELECT '{name}' AS portfolio_id, date, x.s AS symbol, x.w AS weight FROM (SELECT date, unnest(book) AS x FROM {name}_scan WHERE i > 0)", f"{name}_scan")


path("banded", "w_cap", "book", "15e-2", band="2e-2")
path("limited", "w_cap", "book", "15e-2", turnover="313701593871e-12")

# The full run with several settings side by side.
q.step("sweep_top", select_n("run_book", 10), "run_book")
q.step("sweep_raw", raw("sweep_top", "1e0", 5), "sweep_top")
q.step("sweep_plain", cap("sweep_raw", "15e-2"), "sweep_raw")
q.step("sweep_topq", select_quantile("run_book", 8, "4e-1"), "run_book")
q.step("sweep_rawq", raw("sweep_topq", "1e0", 5), "sweep_topq")
q.step("sweep_quantile", cap("sweep_rawq", "12e-2"), "sweep_rawq")
path("sweep_banded", "sweep_plain", "run_dates", "15e-2", band="2e-2")
path("sweep_limited", "sweep_plain", "run_dates", "15e-2", turnover="313701593871e-12")
SWEEP = ("plain", "banded", "limited", "quantile")
for _name in SWEEP:
    q.step(f"sweep_{_name}_main", f"SELECT 'main' AS portfolio_id, date, symbol, weight FROM sweep_{_name}", f"sweep_{_name}")
    equity(f"sw_{_name}", f"sweep_{_name}_main", "cal")


def sweep() -> str:
    one = [stats(f"sw_{n}", f"sweep_{n}_main", "run_dates").replace("'main' AS portfolio_id", f"'{n}' AS portfolio_id") for n in SWEEP]
    return q.build(" UNION ALL ".join(f"({x})" for x in one), *[f"sw_{n}_path" for n in SWEEP], *[f"sweep_{n}_main" for n in SWEEP], "run_dates")
