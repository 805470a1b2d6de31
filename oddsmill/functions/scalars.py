"""Column expressions: coercion, time, tags, outcomes, sizing and unit profit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MILLIS_ABOVE = 10_000_000_000

# Spellings accepted for booleans and outcomes.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
OUTCOME_WORDS = {
    "Yes": ("yes", "true", "1", "winner_yes", "resolved_yes"),
    "No": ("no", "false", "0", "winner_no", "resolved_no"),
    "Invalid": ("invalid", "void", "voided", "cancelled", "canceled"),
    "Unresolved": ("unresolved", "pending"),
}
ANCHOR_OUTCOMES = ("yes", "true")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_present(*cols: Column | str) -> Column:
    """First value that is neither null nor an empty string; zero and false count as present."""
    return F.coalesce(*[F.when(col(c).cast("string") != "", col(c)) for c in cols])


def to_double(c: Column | str) -> Column:
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_long(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("bigint"), to_double(c).cast("bigint"))


def to_bool(c: Column | str) -> Column:
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def seconds_from_number(c: Column | str) -> Column:
    whole = col(c).try_cast("bigint")
    return F.when(whole > MILLIS_ABOVE, F.floor(whole / 1000)).otherwise(whole)


def seconds_from_text(c: Column | str) -> Column:
    return F.unix_timestamp(col(c).try_cast("timestamp"))


def floor_to(ts: Column | str, step: int) -> Column:
    return col(ts) - F.pmod(col(ts), F.lit(step).cast("bigint"))


def canonical_outcome(c: Column | str) -> Column:
    word = F.lower(F.trim(col(c).cast("string")))
    out = F.lit(None).cast("string")
    for label, words in OUTCOME_WORDS.items():
        out = F.when(word.isin(*words), F.lit(label)).otherwise(out)
    return out


def outcome_norm(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def is_anchor(c: Column | str) -> Column:
    return outcome_norm(c).isin(*ANCHOR_OUTCOMES)


def resolution_state(flag: Column, outcome: Column) -> tuple[Column, Column]:
    """(resolved, outcome) from an optional flag and a canonical outcome."""
    resolved = F.coalesce(flag, F.coalesce(outcome.isin("Yes", "No", "Invalid"), F.lit(False)))
    kept = F.when(resolved, F.coalesce(outcome, F.lit("Unresolved"))).otherwise(
        F.when(outcome == "Unresolved", outcome)
    )
    return resolved, kept


def market_type(given: Column, token_count: Column) -> Column:
    derived = (
        F.when(token_count == 2, "binary").when(token_count > 2, "multi").otherwise("unknown")
    )
    return F.lower(F.coalesce(given, derived))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def list_items(c: Column | str) -> Column:
    """array<string> from JSON text, a comma list or a JSON scalar."""
    none = F.array().cast("array<string>")

    def read(text: Column, parsed: Column) -> Column:
        # The JSON reader stops after the first value, so a quoted comma list would pass as one string.
        whole = (F.schema_of_variant(parsed) != "STRING") | text.rlike(r'^"([^"\\]|\\.)*"$')
        split = F.filter(
            F.transform(F.split(text, ","), lambda p: F.trim(F.trim(F.trim(p), F.lit('"')), F.lit("'"))),
            lambda p: p != "",
        )
        scalar = F.try_variant_get(parsed, "$", "string")
        other = (
            F.when(text.isNull() | (text == ""), none)
            .when(parsed.isNull() | ~whole, split)
            .when(F.is_variant_null(parsed) | (scalar == ""), none)
            .otherwise(F.array(scalar))
        )
        return F.coalesce(F.try_variant_get(parsed, "$", "array<string>"), other)

    return once(F.trim(col(c)), lambda text: once(F.try_parse_json(text), lambda parsed: read(text, parsed)))


def tag_from_json(c: Column | str) -> Column:
    """First element of a JSON array, the text itself when it is not JSON, else 'unknown'."""
    text = col(c).cast("string")
    parsed = F.try_parse_json(text)
    head = F.try_variant_get(parsed, "$[0]", "string")
    head = F.when(~head.isin("", "0", "false"), head)
    raw = F.trim(text)
    raw = F.when((raw != "") & (raw != "nan"), raw)
    return F.coalesce(F.when(parsed.isNull(), raw).otherwise(head), F.lit("unknown"))


# Fixed value: leading-tag pattern.
LEADING_TAG = r'^\["?([^",\]]+)'


def tag_from_pattern(c: Column | str) -> Column:
    found = F.regexp_extract(col(c).cast("string"), LEADING_TAG, 1)
    return F.coalesce(F.when(found != "", found), F.lit("unknown"))


def kelly_fraction(probability: Column, entry_price: Column) -> Column:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability))
    c = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), entry_price))
    odds = (1.0 - c) / c
    raw = (p * odds - (1.0 - p)) / odds
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def position_size(
    mode: str,
    bankroll: Column,
    confidence: Column,
    entry_price: Column,
    *,
    flat: float = 100.0,
    fraction: float = 0.25,
    max_pct: float = 0.05,
    minimum: float = 1.0,
) -> tuple[Column, Column]:
    """(raw Kelly fraction, size) for a bankroll; size 0 means no trade."""
    cash = F.greatest(F.lit(0.0), bankroll)
    if mode.lower() == "kelly":
        raw = kelly_fraction(confidence, entry_price)
        wanted = cash * raw * fraction
        open_ = (cash > 0) & (raw > 0)
    else:
        raw = F.lit(0.0)
        wanted = F.lit(float(flat))
        open_ = cash > 0
    cap = cash * max_pct
    size = F.when(cap > 0, F.least(wanted, cap)).otherwise(wanted)
    return (
        F.when(cash > 0, raw).otherwise(F.lit(0.0)),
        F.when(open_ & (size >= minimum), size).otherwise(F.lit(0.0)),
    )


DEFAULT_SPREAD = 0.03


def usable_spread(c: Column | str) -> Column:
    return F.when(col(c) > 0, col(c)).otherwise(F.lit(DEFAULT_SPREAD))


def round_even(x: Column, digits: int) -> Column:
    """x to so many digits, ties of the scaled double to even as SQL's round_even has them; bround takes the ties of x as printed.

    0.63455 is below its tie: scaled it is 6345.499999999999 and gives 0.6345.
    """
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(F.rint(scaled) / F.lit(10.0**digits))


def damped_confidence(strength: Column, volume: Column, points: Column) -> Column:
    """Strength scaled by liquidity and data volume; a missing volume or count does not damp."""
    base = F.least(F.lit(0.8), F.greatest(F.lit(0.0), strength))
    liquid = F.when(volume.isNull(), 1.0).otherwise(F.least(F.lit(1.0), volume / 500.0))
    enough = F.when(points.isNull(), 1.0).otherwise(F.least(F.lit(1.0), points / 100.0))
    return round_even(F.greatest(F.lit(0.0), base * liquid * enough), 4)


def unit_trade(direction: Column, entry: Column, exit_: Column, spread: Column) -> tuple[Column, Column, Column]:
    """(entry cost, profit per unit, return) after paying half the spread on both legs."""
    half = F.greatest(F.lit(0.0), spread / 2.0)
    buy = direction == "buy"
    cost = F.when(buy, entry + half).otherwise((1.0 - entry) + half)
    proceeds = F.when(buy, exit_ - half).otherwise((1.0 - exit_) - half)
    profit = proceeds - cost
    return cost, profit, profit / F.greatest(F.lit(1e-9), cost)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def safe_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation, null for a constant series (plain corr raises under ANSI)."""
    den = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(den, F.lit(0.0))
