"""Plain-Python statements of the rules, one row at a time; tests compare the Spark jobs with these."""

import datetime as dt
import math
import random
import statistics as st

ROOT = 15.874507866


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def walk(n, seed, drift=0.0005, vol=0.015, start=100.0):
    rng = random.Random(seed)
    out, x = [], start
    for _ in range(n):
        x *= math.exp(rng.gauss(drift, vol))
        out.append(x)
    return out


def drawdown(xs):
    peak, worst = -math.inf, 0.0
    for x in xs:
        peak = max(peak, x)
        worst = min(worst, (x - peak) / (peak if peak > 0 else 1.0))
    return worst


def slope(ys):
    n = len(ys)
    mx, my = (n - 1) / 2, sum(ys) / n
    return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))


def features(closes, volumes):
    """All features at every bar of one symbol; None marks a missing close or feature."""
    rets, hist, out = [], [], []
    for i, c in enumerate(closes):
        prev = closes[i - 1] if i else None
        rets.append(c / prev - 1 if c is not None and prev is not None and prev > 0 else None)
        n, f = i + 1, {}

        def change(k):
            past = closes[i - k] if i >= k else None
            return c / past - 1 if c is not None and past is not None and past > 0 else None

        def mean(k):
            w = closes[n - k : n]
            return sum(w) / k if n >= k and None not in w else None

        def vol(k, least):
            w = [r for r in rets[max(0, n - k) : n] if r is not None]
            return st.stdev(w) if n >= k and len(w) >= least else None

        f["ret1"], f["mom5"], f["mom21"], f["mom63"] = change(1), change(5), change(21), change(63)
        f["sma20"], f["sma50"], f["sma200"] = mean(20), mean(50), mean(200)
        f["trend_gap"] = (f["sma50"] - f["sma200"]) / f["sma200"] if f["sma200"] else None
        v20, v60 = vol(20, 15), vol(60, 45)
        f["rv20"] = v20 * ROOT if v20 is not None else None
        f["rv60"] = v60 * ROOT if v60 is not None else None
        if v20 is not None:
            hist.append(v20 * ROOT)
        h = hist[-252:]
        sd = st.stdev(h) if len(h) >= 60 else 0.0
        f["rv20_z"] = (h[-1] - st.fmean(h)) / sd if sd > 0 else None
        dv = [a * b if a is not None else None for a, b in zip(closes, volumes)][max(0, n - 20) : n]
        f["adv20"] = sum(dv) / 20 if n >= 20 and None not in dv else None
        d = f["sma20"] * v20 if f["sma20"] is not None and v20 is not None else 0
        f["dev20"] = (c - f["sma20"]) / d if d else None
        w90 = closes[max(0, n - 90) : n]
        f["max_dd_90"] = drawdown([x for x in w90 if x is not None]) if n >= 90 else None
        w50 = closes[max(0, n - 50) : n]
        f["normalized_slope"] = None
        if n >= 50 and None not in w50:
            lc = [math.log(max(x, 1e-10)) for x in w50]
            lv = st.stdev([b - a for a, b in zip(lc, lc[1:])])
            f["normalized_slope"] = slope(lc) / lv if lv else None
        out.append(f)
    return out


def hysteresis(rows, gate, least, klass, start, instant=()):
    """(label, confidence, days, since) per row; a row is (date, raw by class, confidence by class, skip)."""
    label, n, since, out = None, 0, None, []
    for date, raw, conf, skip in rows:
        if skip:
            out.append((None, None, None, None))
            continue
        k = start if label is None else klass[label]
        new, c = raw[k], conf[k]
        if label is None:
            label, n, since = new, 1, date
        elif new == label:
            n += 1
        elif new in instant:
            label, n, since = new, 1, date
        elif n < least:
            n, c = n + 1, c * 0.5
        elif c < gate:
            n += 1
        else:
            label, n, since = new, 1, date
        out.append((label, c, n, since))
    return out


def cap(weights, limit):
    """Clip at the limit, spread the excess over the free ones, repeat until nothing is clipped."""
    w, fixed = dict(weights), set()
    if sum(w.values()) <= 0:
        return w
    while True:
        over = [s for s in w if s not in fixed and w[s] > limit]
        excess = sum(w[s] - limit for s in over)
        if excess <= 0:
            return w
        fixed.update(over)
        for s in over:
            w[s] = limit
        free = [s for s in w if s not in fixed]
        room = sum(w[s] for s in free)
        if room <= 0:
            return w
        for s in free:
            w[s] *= 1 + excess / room


def ranks(values):
    """Average zero-based rank over n - 1."""
    n = len(values)
    return [(sum(u < v for u in values) + (sum(u == v for u in values) - 1) / 2) / (n - 1) for v in values]


def auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y]
    neg = [p for y, p in zip(ys, ps) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def close(a, b, tol=1e-9):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def market_raw(z, dd, slope, flag, prev, cfg):
    """(label code, confidence): 0 up, 1 down, 2 choppy, 3 stressed; None marks a missing value."""
    zl, dl = (cfg.z_exit, cfg.dd_exit) if prev == 3 else (cfg.z_enter, cfg.dd_enter)
    if (z is not None and z > zl) or (dd is not None and dd < dl):
        by_vol = (z - zl) / cfg.margin_scale if z is not None else 0.0
        by_fall = (dl - dd) / (abs(dl) * cfg.margin_scale) if dd is not None else 0.0
        return 3, min(1.0, max(0.0, 0.5 + 0.5 * max(by_vol, by_fall)))
    way, sure = 0, 0.5
    if slope is not None:
        up, down = (cfg.up_exit if prev == 0 else cfg.up_enter), (cfg.down_exit if prev == 1 else cfg.down_enter)
        way = 1 if slope > up else -1 if slope < down else 0
        sure = min(1.0, 0.5 + abs(slope) / cfg.margin_scale * 0.5)
    if flag:
        if way == 0:
            way = flag
        else:
            sure += cfg.agreement_weight if way == flag else -cfg.agreement_weight / 2
        sure = min(1.0, max(0.0, sure))
    return {1: 0, -1: 1, 0: 2}[way], sure


def stock_raw(f, stressed, prev, cfg):
    """(label code, confidence): 0 up, 1 down, 2 range, 3 stressed, 4 no trade."""
    unit = lambda x: min(1.0, max(0.0, x))
    s, rv = f["normalized_slope"], f["rv20"]
    if s is None or rv is None:
        return 4, 0.0
    z, dd, mom = f["rv20_z"] or 0.0, f["max_dd_90"] or 0.0, f["mom63"] or 0.0
    gap = f["trend_gap"]
    ma = 0 if gap is None else 1 if gap > 0 else -1
    if prev == 3:
        zl, dl = cfg.z_exit, cfg.dd_exit
    else:
        zl, dl = cfg.z_enter - (cfg.market_stress_z_shift if stressed else 0), cfg.dd_enter
    if z >= zl or dd <= dl:
        margin = max((z - zl) / 2 if z >= zl else 0, (dl - dd) / abs(dl) / 2 if dd <= dl else 0)
        return 3, unit(0.55 + 0.45 * margin)
    up = s >= (cfg.slope_exit if prev == 0 else cfg.slope_enter) and mom > 0
    down = s <= -(cfg.slope_exit if prev == 1 else cfg.slope_enter) and mom < 0
    if up or down:
        agree = 0.1 if ma * (1 if up else -1) > 0 else -0.05
        conf = unit(unit(0.5 + (abs(s) - cfg.slope_exit) / 3) + agree + 0.1 * unit(2 * abs(mom)))
        return (0 if up else 1), unit(conf * (cfg.market_stress_penalty if stressed else 1))
    if abs(s) <= cfg.range_slope_ceil:
        return 2, unit(0.45 + 0.35 * unit(1 - abs(s) / cfg.range_slope_ceil) + 0.2 * unit(1 - rv / cfg.low_vol_ceil))
    return 2, 0.45
