"""SQL building blocks for the registered queries' DuckDB counterparts.

Each block is a list of (name, select) steps; ``build`` chains the steps a query needs into one WITH.
Numbers are written with an exponent so DuckDB reads them as doubles.
"""

from __future__ import annotations


def _day(symbol: str, source: str) -> str:
    return f"""SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
      CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax,
      CAST(count(*) AS DOUBLE) AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty
    FROM {source} GROUP BY 1, 2"""


def _walk(day: str, k: str, a: str, phase: str) -> str:
    return f"""SELECT symbol, date, coalesce(lag(close) OVER w, close) AS open,
      round(greatest(coalesce(lag(close) OVER w, close), close) * exp(spread), 4) AS high,
      round(least(coalesce(lag(close) OVER w, close), close) * exp(-spread), 4) AS low, close, qty AS volume
    FROM (SELECT symbol, date, qty, 1e-2 * (tax / 1e2 / c) AS spread,
            round(1e2 * exp(sum({k} * (disc / 1e2 / c - 5e-2) + {a} * sin(2e0 * pi() *
              (date_diff('day', DATE '1995-01-01', date) + {phase}) / 4e2))
              OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) AS close
          FROM {day})
    WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, sql: str, *needs: str) -> None:
    STEPS[name] = (needs, sql)


step("brand_day", _day("p_brand", "lineitem JOIN part ON l_partkey = p_partkey"))
step(
    "bars",
    _walk("brand_day", "4e-1", "6e-3", "37 * CAST(regexp_extract(symbol, '#([0-9]+)$', 1) AS INT)"),
    "brand_day",
)
step("market_day", _day("'MKT'", "lineitem"))
step("market_bars", _walk("market_day", "1.2e0", "4e-3", "0"), "market_day")
step("all_bars", "SELECT * FROM bars UNION ALL SELECT * FROM market_bars", "bars", "market_bars")
step(
    "cal",
    """SELECT date, row_number() OVER (ORDER BY date) AS idx, lead(date) OVER (ORDER BY date) AS next_trading_date
       FROM (SELECT DISTINCT date FROM all_bars)""",
    "all_bars",
)
_W = "PARTITION BY symbol ORDER BY date"
step(
    "f1",
    f"""SELECT *, row_number() OVER w AS n, lead(date) OVER w AS next_date, lag(close) OVER w AS p1,
          lag(close, 5) OVER w AS p5, lag(close, 21) OVER w AS p21, lag(close, 63) OVER w AS p63,
          ln(greatest(close, 1e-10)) AS lc, close * volume AS dv
        FROM bars WINDOW w AS ({_W})""",
    "bars",
)
step(
    "f2",
    f"""SELECT *, CASE WHEN p1 > 0 THEN close / p1 - 1 END AS ret, lc - lag(lc) OVER ({_W}) AS lr FROM f1""",
    "f1",
)
step(
    "f3",
    f"""SELECT *,
          CASE WHEN n >= 20 THEN avg(close) OVER ({_W} ROWS 19 PRECEDING) END AS sma20,
          CASE WHEN n >= 50 THEN avg(close) OVER ({_W} ROWS 49 PRECEDING) END AS sma50,
          CASE WHEN n >= 200 THEN avg(close) OVER ({_W} ROWS 199 PRECEDING) END AS sma200,
          CASE WHEN count(dv) OVER ({_W} ROWS 19 PRECEDING) = 20 THEN avg(dv) OVER ({_W} ROWS 19 PRECEDING) END AS adv20,
          CASE WHEN n >= 20 AND count(ret) OVER ({_W} ROWS 19 PRECEDING) >= 15
               THEN stddev_samp(ret) OVER ({_W} ROWS 19 PRECEDING) END AS vol20,
          CASE WHEN n >= 60 AND count(ret) OVER ({_W} ROWS 59 PRECEDING) >= 45
               THEN stddev_samp(ret) OVER ({_W} ROWS 59 PRECEDING) END AS vol60,
          regr_slope(lc, n) OVER ({_W} ROWS 49 PRECEDING) AS fit,
          stddev_samp(lr) OVER ({_W} ROWS 48 PRECEDING) AS slr
        FROM f2""",
    "f2",
)


def drawdown(source: str, size: int) -> str:
    return f"""SELECT symbol, n, min(fall) AS dd FROM (
        SELECT a.symbol, a.n, b.close / max(b.close) OVER (PARTITION BY a.symbol, a.n ORDER BY b.n) - 1 AS fall
        FROM (SELECT symbol, n, unnest(range(0, {size})) AS k FROM {source} WHERE n >= {size}) a
        JOIN {source} b ON a.symbol = b.symbol AND b.n = a.n - a.k) GROUP BY 1, 2"""


step("dd90", drawdown("f1", 90), "f1")
step(
    "hist",
    f"""SELECT symbol, n, CASE WHEN count(*) OVER v >= 60 AND stddev_samp(vol20 * 15.874507866e0) OVER v > 0
          THEN (vol20 * 15.874507866e0 - avg(vol20 * 15.874507866e0) OVER v)
               / stddev_samp(vol20 * 15.874507866e0) OVER v END AS rv20_z
        FROM f3 WHERE vol20 IS NOT NULL WINDOW v AS ({_W} ROWS 251 PRECEDING)""",
    "f3",
)
step(
    "feats",
    """SELECT f3.symbol, f3.date, f3.n, f3.next_date, f3.close, f3.volume, f3.ret AS ret1,
          CASE WHEN p5 > 0 THEN close / p5 - 1 END AS mom5, CASE WHEN p21 > 0 THEN close / p21 - 1 END AS mom21,
          CASE WHEN p63 > 0 THEN close / p63 - 1 END AS mom63, sma20, sma50, sma200,
          CASE WHEN sma200 <> 0 THEN (sma50 - sma200) / sma200 END AS trend_gap,
          vol20 * 15.874507866e0 AS rv20, vol60 * 15.874507866e0 AS rv60, rv20_z, adv20,
          CASE WHEN sma20 * vol20 <> 0 THEN (close - sma20) / (sma20 * vol20) END AS dev20,
          dd90.dd AS max_dd_90, CASE WHEN f3.n >= 50 AND slr <> 0 THEN fit / slr END AS normalized_slope
        FROM f3 LEFT JOIN hist USING (symbol, n) LEFT JOIN dd90 USING (symbol, n)""",
    "f3", "hist", "dd90",
)
PANEL_COLS = ["ret1", "mom5", "mom21", "mom63", "sma20", "sma50", "sma200", "trend_gap", "rv20", "rv60", "rv20_z",
              "adv20", "dev20", "max_dd_90", "normalized_slope"]
_seen = ", ".join(f"f.{c}" for c in PANEL_COLS)
step(
    "panel",
    f"""SELECT c.date, u.symbol, coalesce(f.n, 0) AS n, coalesce(f.date = c.date, FALSE) AS fresh, {_seen}
        FROM (SELECT date FROM cal) c
        JOIN (SELECT DISTINCT symbol FROM feats) u ON TRUE
        LEFT JOIN feats f ON f.symbol = u.symbol AND f.date <= c.date
          AND (f.next_date > c.date OR f.next_date IS NULL)""",
    "cal", "feats",
)

# Market features on the benchmark.
step(
    "m1",
    f"SELECT symbol, date, close, row_number() OVER w AS n, ln(close) AS lc, ln(close) - lag(ln(close)) OVER w AS log_return "
    f"FROM market_bars WINDOW w AS ({_W})",
    "market_bars",
)
step(
    "m2",
    f"""SELECT *, CASE WHEN n >= 50 THEN avg(close) OVER ({_W} ROWS 49 PRECEDING) END AS ma_short,
          CASE WHEN n >= 200 THEN avg(close) OVER ({_W} ROWS 199 PRECEDING) END AS ma_long,
          CASE WHEN count(log_return) OVER ({_W} ROWS 19 PRECEDING) = 20
               THEN stddev_samp(log_return) OVER ({_W} ROWS 19 PRECEDING) * 15.874507866e0 END AS rv20_log,
          regr_slope(lc, n) OVER ({_W} ROWS 49 PRECEDING) AS fit,
          stddev_samp(log_return) OVER ({_W} ROWS 48 PRECEDING) AS sdt
        FROM m1""",
    "m1",
)
step(
    "m3",
    f"""SELECT *, CASE WHEN count(rv20_log) OVER w >= 252 THEN avg(rv20_log) OVER w END AS vol_mean,
          CASE WHEN count(rv20_log) OVER w >= 252 THEN stddev_samp(rv20_log) OVER w END AS vol_sd
        FROM m2 WINDOW w AS ({_W} ROWS 503 PRECEDING)""",
    "m2",
)
step("mdd", drawdown("m1", 90), "m1")
step(
    "mfeats",
    """SELECT m3.symbol, m3.date, m3.n, m3.close, log_return, rv20_log, vol_mean, vol_sd,
          CASE WHEN vol_sd <> 0 THEN (rv20_log - vol_mean) / vol_sd END AS z_vol, mdd.dd AS max_dd,
          CASE WHEN m3.n >= 50 AND sdt > 0 THEN fit / sdt END AS normalized_slope, ma_short, ma_long,
          CASE WHEN ma_short > ma_long THEN 1 WHEN ma_short < ma_long THEN -1 ELSE 0 END AS ma_flag
        FROM m3 LEFT JOIN mdd USING (symbol, n)""",
    "m3", "mdd",
)


def _m_stress(z: str, dd: str, add: str) -> tuple[str, str]:
    hit = f"(coalesce(z_vol > {z}, FALSE) OR coalesce(max_dd < {dd}, FALSE))"
    conf = (
        f"least(1e0, greatest(0e0, 5e-1 + 5e-1 * greatest(coalesce((z_vol - {z}) / 2e0, 0e0), "
        f"coalesce(({dd} - max_dd) / ({add} * 2e0), 0e0))))"
    )
    return hit, conf


def _m_trend(up: str, down: str) -> tuple[str, str]:
    way = f"(CASE WHEN normalized_slope > {up} THEN 1 WHEN normalized_slope < {down} THEN -1 ELSE 0 END)"
    sure = "(CASE WHEN normalized_slope IS NOT NULL THEN least(1e0, 5e-1 + abs(normalized_slope) / 2e0 * 5e-1) ELSE 5e-1 END)"
    bonus = f"(CASE WHEN {way} = ma_flag THEN 3e-1 WHEN {way} = 0 THEN 0e0 ELSE -15e-2 END)"
    return (
        f"(CASE WHEN ma_flag <> 0 AND {way} = 0 THEN ma_flag ELSE {way} END)",
        f"(CASE WHEN ma_flag <> 0 THEN least(1e0, greatest(0e0, {sure} + {bonus})) ELSE {sure} END)",
    )


def _m_raw(z_in: str = "1.5e0", dd_in: str = "1e-1", z_out: str = "1e0", dd_out: str = "7e-2") -> str:
    enter, leave = _m_stress(z_in, f"-{dd_in}", dd_in), _m_stress(z_out, f"-{dd_out}", dd_out)
    plain = _m_trend("5e-1", "-5e-1")
    classes = [(enter, _m_trend("2e-1", "-5e-1")), (enter, _m_trend("5e-1", "-2e-1")), (enter, plain), (leave, plain)]
    cols = []
    for k, ((hit, sc), (way, tc)) in enumerate(classes):
        cols.append(f"CASE WHEN {hit} THEN 3 WHEN {way} > 0 THEN 0 WHEN {way} < 0 THEN 1 ELSE 2 END AS r{k}")
        cols.append(f"CASE WHEN {hit} THEN {sc} ELSE {tc} END AS c{k}")
    return ", ".join(cols)


M_NAME = "CASE {c} WHEN 0 THEN 'calm_trending_up' WHEN 1 THEN 'calm_trending_down' WHEN 2 THEN 'choppy_normal' WHEN 3 THEN 'stressed' END"
M_LABEL = "CASE {c} WHEN 0 THEN 'calm_trend' WHEN 1 THEN 'calm_trend' WHEN 2 THEN 'calm_range' WHEN 3 THEN 'stress' END"
step("mraw", f"SELECT *, {_m_raw()} FROM mfeats", "mfeats")
step("msig_live", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM mraw WHERE n >= 30", "mraw")
step(
    "msig_batch",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM mraw
       WHERE n >= 272 AND z_vol IS NOT NULL AND max_dd IS NOT NULL AND normalized_slope IS NOT NULL""",
    "mraw",
)


def fold(sig: str, start: int, classes: dict[int, int], gate: str, least_days: int, instant: int | None) -> str:
    """Recursive step: previous label and days pick the proposal, then duration and gate decide."""
    raw = "CASE f.label " + " ".join(f"WHEN {c} THEN s.r{k}" for c, k in classes.items()) + " END"
    conf = "CASE f.label " + " ".join(f"WHEN {c} THEN s.c{k}" for c, k in classes.items()) + " END"
    now = "FALSE" if instant is None else f"raw = {instant}"
    stay = f"raw = label OR (NOT ({now}) AND (days < {least_days} OR c < {gate}))"
    return f"""SELECT symbol, i, date, r{start} AS label, 1 AS days, c{start} AS conf, date AS since,
        r{start} AS raw_label, c{start} AS raw_conf FROM {sig} WHERE i = 1
      UNION ALL
      SELECT symbol, i, date, CASE WHEN {stay} THEN label ELSE raw END, CASE WHEN {stay} THEN days + 1 ELSE 1 END,
        CASE WHEN raw <> label AND NOT ({now}) AND days < {least_days} THEN c * 5e-1 ELSE c END,
        CASE WHEN {stay} THEN since ELSE date END, raw, c
      FROM (SELECT s.symbol, s.i, s.date, f.label, f.days, f.since, {raw} AS raw, {conf} AS c
            FROM {{me}} f JOIN {sig} s ON s.symbol = f.symbol AND s.i = f.i + 1)"""


_MC = {0: 0, 1: 1, 2: 2, 3: 3}
_BATCH = "n >= 272 AND z_vol IS NOT NULL AND max_dd IS NOT NULL AND normalized_slope IS NOT NULL"
for _preset, _levels, _gate, _least in (
    ("conservative", ("2e0", "12e-2", "12e-1", "8e-2"), "7e-1", 10),
    ("sensitive", ("12e-1", "8e-2", "8e-1", "5e-2"), "5e-1", 5),
):
    step(f"msig_{_preset}", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, {_m_raw(*_levels)} FROM mfeats WHERE {_BATCH}", "mfeats")
    step(f"mstate_{_preset}", fold(f"msig_{_preset}", 2, _MC, _gate, _least, None), f"msig_{_preset}")
step("mstate_live", fold("msig_live", 2, _MC, "6e-1", 7, None), "msig_live")
step("mstate_batch", fold("msig_batch", 2, _MC, "6e-1", 7, None), "msig_batch")
step(
    "market",
    f"""SELECT m.date, coalesce({M_LABEL.format(c='s.label')}, 'calm_range') AS label, coalesce(s.conf, 0e0) AS confidence
        FROM mfeats m LEFT JOIN mstate_live s ON s.symbol = m.symbol AND s.date = m.date""",
    "mfeats", "mstate_live",
)
step(
    "market_rule",
    f"""SELECT date, CASE WHEN max_dd < -3e-1 THEN 'crisis' ELSE {M_LABEL.format(c='r2')} END AS label, c2 AS confidence
        FROM mraw WHERE n >= 200""",
    "mraw",
)


def _s_raw() -> str:
    def stress(z: str, dd: str, add: str) -> tuple[str, str]:
        vol = f"CASE WHEN vol_z >= {z} THEN greatest(0e0, (vol_z - {z}) / 2e0) ELSE 0e0 END"
        fall = f"CASE WHEN max_dd <= {dd} THEN greatest(0e0, ({dd} - max_dd) / {add} / 2e0) ELSE 0e0 END"
        return f"(vol_z >= {z} OR max_dd <= {dd})", f"least(1e0, greatest(0e0, 55e-2 + greatest({vol}, {fall}) * 45e-2))"

    def trend(up: str, down: str) -> tuple[str, str]:
        u, d = f"(normalized_slope >= {up} AND mom63 > 0)", f"(normalized_slope <= -{down} AND mom63 < 0)"
        way = f"(CASE WHEN {u} THEN 1e0 ELSE -1e0 END)"
        base = "least(1e0, greatest(0e0, 5e-1 + (abs(normalized_slope) - 2e-1) / 3e0))"
        agree = f"(CASE WHEN ma_trend * {way} > 0 THEN 1e-1 ELSE -5e-2 END)"
        mom = "least(1e0, greatest(0e0, abs(mom63) * 2e0)) * 1e-1"
        return (f"(CASE WHEN {u} THEN 0 WHEN {d} THEN 1 END)", f"least(1e0, greatest(0e0, {base} + {agree} + {mom}))")

    z = "(CASE WHEN market_stressed THEN 12e-1 ELSE 15e-1 END)"
    enter, leave = stress(z, "-2e-1", "2e-1"), stress("1e0", "-12e-2", "12e-2")
    flat = "least(1e0, greatest(0e0, 1e0 - abs(normalized_slope) / 3e-1))"
    calm = "least(1e0, greatest(0e0, 1e0 - rv20 / 25e-2))"
    quiet = (
        f"(CASE WHEN abs(normalized_slope) <= 3e-1 THEN least(1e0, greatest(0e0, 45e-2 + 35e-2 * {flat} + 2e-1 * {calm})) "
        "ELSE 45e-2 END)"
    )
    classes = [(enter, trend("2e-1", "5e-1")), (enter, trend("5e-1", "2e-1")), (enter, trend("5e-1", "5e-1")),
               (leave, trend("5e-1", "5e-1"))]
    damp = "(CASE WHEN market_stressed THEN 8e-1 ELSE 1e0 END)"
    cols = []
    for k, ((hit, sc), (code, tc)) in enumerate(classes):
        cols.append(f"CASE WHEN NOT tradeable THEN 4 WHEN {hit} THEN 3 ELSE coalesce({code}, 2) END AS r{k}")
        cols.append(
            f"CASE WHEN NOT tradeable THEN 0e0 WHEN {hit} THEN {sc} WHEN {code} IS NOT NULL "
            f"THEN least(1e0, greatest(0e0, {tc} * {damp})) ELSE {quiet} END AS c{k}"
        )
    return ", ".join(cols)


SIGNALS = """normalized_slope, rv20 / 15.874507866e0 AS daily_vol, coalesce(rv20_z, 0e0) AS vol_z,
  coalesce(max_dd_90, 0e0) AS max_dd, coalesce(mom63, 0e0) AS mom63,
  CASE WHEN trend_gap IS NULL THEN 0e0 WHEN trend_gap > 0 THEN 1e0 ELSE -1e0 END AS ma_trend, rv20,
  (normalized_slope IS NOT NULL AND rv20 IS NOT NULL) AS tradeable"""
S_LABEL = "CASE {c} WHEN 0 THEN 'trending_up' WHEN 1 THEN 'trending_down' WHEN 2 THEN 'range_low_vol' WHEN 3 THEN 'stressed_high_vol' WHEN 4 THEN 'no_trade' END"
step("srule_sig", f"SELECT symbol, date, {SIGNALS}, FALSE AS market_stressed FROM feats", "feats")
step("srule_raw", f"SELECT *, {_s_raw()} FROM srule_sig", "srule_sig")
step("stock_rule", f"SELECT symbol, date, {S_LABEL.format(c='r2')} AS label, c2 AS confidence FROM srule_raw", "srule_raw")
step(
    "ssig0",
    f"""SELECT p.symbol, p.date, {SIGNALS}, coalesce(m.label IN ('stress', 'crisis'), FALSE) AS market_stressed
        FROM panel p LEFT JOIN market m ON m.date = p.date""",
    "panel", "market",
)
step(
    "ssig",
    f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, {_s_raw()} FROM ssig0",
    "ssig0",
)
step("sstate", fold("ssig", 2, {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}, "6e-1", 7, 3), "ssig")
step(
    "stock",
    f"SELECT symbol, date, {S_LABEL.format(c='label')} AS label, least(1e0, greatest(0e0, conf)) AS confidence, days, since FROM sstate",
    "sstate",
)

# Alpha models side by side, then blended and routed; source tables are given by name.
_SIG = {"momentum": "mom63", "meanrev": "-dev20", "lowvol": "-coalesce(rv60, rv20)"}
_CONF = {
    "momentum": "least(1e0, greatest(0e0, abs(momentum_z) / 3e0))",
    "meanrev": "least(1e0, greatest(0e0, abs(dev20) / 2e0)) * "
               "least(1e0, greatest(0e0, 1e0 - greatest(0e0, coalesce(rv20_z, 0e0)) / 2e0))",
    "lowvol": "CASE WHEN lowvol_z IS NOT NULL THEN 7e-1 END",
}


def models(source: str) -> str:
    z = ", ".join(
        f"""CASE WHEN {s} IS NOT NULL THEN least(3e0, greatest(-3e0, CASE WHEN count({s}) OVER d < 2 THEN 0e0
            WHEN stddev_pop({s}) OVER d < 1e-12 THEN 0e0 ELSE ({s} - avg({s}) OVER d) / stddev_pop({s}) OVER d END)) END AS {m}_z"""
        for m, s in _SIG.items()
    )
    conf = ", ".join(f"{c} AS {m}_conf" for m, c in _CONF.items())
    return f"SELECT *, {conf} FROM (SELECT *, {z} FROM {source} WINDOW d AS (PARTITION BY date))"


_EW = {"calm_trend": (0.80, 0.05, 0.15), "calm_range": (0.20, 0.70, 0.10), "stress": (0.20, 0.10, 0.70), "crisis": (0, 0, 0)}
_RW = {"trending_up": (1, 0, 1), "range_low_vol": (0.3, 1, 1), "stressed_high_vol": (0, 0.3, 0.5)}
_SW = (0.5, 0.7, 1.0)
ORDER = ("momentum", "meanrev", "lowvol")


def weight_cases(m: str) -> tuple[str, str]:
    k = ORDER.index(m)
    ew = " ".join(f"WHEN '{lab}' THEN {float(w[k])!r}::DOUBLE" for lab, w in _EW.items())
    rw = " ".join(f"WHEN '{lab}' THEN {float(w[k])!r}::DOUBLE" for lab, w in _RW.items())
    damp = f"(CASE WHEN market_label = 'stress' THEN {_SW[k]!r}::DOUBLE ELSE 1e0 END)"
    return f"(CASE market_label {ew} ELSE 0e0 END)", f"((CASE stock_label {rw} ELSE 0e0 END) * {damp})"


def combined(source: str) -> str:
    """``source`` has the model columns, market_label, stock_label and stock_conf."""
    parts, raws, nums, dens, shown = [], [], [], [], []
    for m in ("lowvol", "meanrev", "momentum"):
        ew, w = weight_cases(m)
        w = f"(CASE WHEN market_label = 'crisis' THEN 0e0 ELSE {w} END)"
        s, c = f"(coalesce({m}_z, 0e0) * {ew})", f"(coalesce({m}_conf, 0e0) * stock_conf)"
        parts.append(f"greatest({s}, 0e0) * {w} * {c}")
        raws.append(f"{s} * {w} * {c}")
        nums.append(f"{c} * {w}")
        dens.append(w)
        shown += [f"greatest({s}, 0e0) * {w} * {c} AS contrib_{m}", f"{w} AS w_{m}"]
    gate = "CASE WHEN market_label = 'crisis' THEN 'market_crisis' WHEN stock_label IN ('no_trade', 'trending_down') THEN 'stock_' || stock_label END"
    den = " + ".join(dens)
    return f"""SELECT *, {' + '.join(parts)} AS combined_score, {' + '.join(raws)} AS raw,
      CASE WHEN {den} > 0 THEN least(1e0, greatest(0e0, ({' + '.join(nums)}) / ({den}))) ELSE 0e0 END AS confidence,
      {gate} AS gate, {', '.join(shown)} FROM {source}"""


def unit_rank(value: str, by: str, single: str) -> str:
    return f"""CASE WHEN {value} IS NULL THEN NULL WHEN count({value}) OVER (PARTITION BY {by}) = 1 THEN {single}
      ELSE (rank() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST) - 1
            + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2e0) / (count({value}) OVER (PARTITION BY {by}) - 1) END"""


step("models", models("feats"), "feats")
step(
    "routed_in",
    """SELECT m.*, s.label AS stock_label, s.confidence AS stock_conf, k.label AS market_label
       FROM models m JOIN stock_rule s USING (symbol, date) JOIN market_rule k USING (date)""",
    "models", "stock_rule", "market_rule",
)
step("routed", combined("routed_in"), "routed_in")
step("alpha", f"SELECT *, {unit_rank('combined_score', 'date', '0e0')} AS score FROM routed", "routed")

# The full evaluation on the panel from its ready date.
step(
    "ready",
    """SELECT min(date) AS d FROM (SELECT date, sum(warm) OVER (ORDER BY date) AS w, sum(born) OVER () AS u FROM (
         SELECT date, count(*) FILTER (n = 200) AS warm, count(*) FILTER (n = 1) AS born FROM feats GROUP BY 1))
       WHERE w > 0 AND w >= u * 8e-1""",
    "feats",
)


def build(final: str, *needs: str) -> str:
    """``WITH RECURSIVE`` of every step ``needs`` leads to, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in STEPS[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return final
    def one(n: str) -> str:
        sql = STEPS[n][1]
        return f"{n} AS ({sql.replace('{me}', n)})" if "{me}" in sql else f"{n} AS MATERIALIZED ({sql})"

    body = ",\n".join(one(n) for n in order)
    return f"WITH RECURSIVE {body}\n{final}"
