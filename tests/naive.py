"""Plain Python forms of the windowed operators, written from their description."""

import math


def grid_series(ticks, step, window_days, limit):
    """ticks: list of (ts, price), later rows win. Returns (clean prices, grid prices, missing ratio) or None."""
    last = {}
    for ts, price in ticks:
        last[ts] = price
    if not last:
        return None
    end = max(last)
    base = {t: p for t, p in sorted(last.items()) if t >= end - window_days * 86_400}
    if len(base) < 3:
        return None
    slots = {}
    for t, p in base.items():
        slots[t - t % step] = p
    lo, hi = min(base), end
    grid = list(range(lo - lo % step, hi + (-hi) % step + 1, step))
    raw = [slots.get(s) for s in grid]
    filled, held, age = [], None, 0
    for p in raw:
        held, age = (p, 0) if p is not None else (held, age + 1)
        filled.append(held if held is not None and age <= limit else None)
    clean = [p for p in filled if p is not None]
    if len(clean) < 3:
        return None
    return clean, filled, sum(p is None for p in raw) / len(raw)


def slope(ys):
    n = len(ys)
    if n < 2:
        return 0.0
    mx, my = (n - 1) / 2, sum(ys) / n
    return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))


def pstd(xs):
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


def rsi(xs, periods=14):
    if len(xs) <= periods:
        return None
    gain = loss = None
    for a, b in zip(xs, xs[1:]):
        g, l = max(b - a, 0.0), max(a - b, 0.0)
        gain = g if gain is None else gain + (g - gain) / periods
        loss = l if loss is None else loss + (l - loss) / periods
    return None if loss == 0 else 100 - 100 / (1 + gain / loss)


def price_features(clean, missing, ppd):
    n = len(clean)
    diffs = [b - a for a, b in zip(clean, clean[1:])]
    peak, fall = clean[0], 0.0
    for p in clean:
        peak = max(peak, p)
        fall = max(fall, peak - p)
    week = clean[-7 * ppd:]
    std = pstd(week)
    back = lambda k: clean[-1] - clean[-1 - k] if n > k else None
    return {
        "p_start": clean[0], "p_end": clean[-1], "max_price": max(clean), "min_price": min(clean),
        "time_of_max": clean.index(max(clean)) / (n - 1), "return_total": clean[-1] - clean[0], "volatility": pstd(diffs),
        "max_drawdown": fall, "slope": slope(clean), "missing_ratio": missing, "num_points": n,
        "return_1d": back(ppd), "return_7d": back(7 * ppd), "return_30d": back(30 * ppd),
        "zscore_7d": (clean[-1] - sum(week) / len(week)) / std if n > 7 * ppd and std > 0 else None, "rsi_14": rsi(clean),
    }


def next_price(ticks, target):
    later = sorted((t, p) for t, p in ticks if t >= target)
    return later[0] if later else None
