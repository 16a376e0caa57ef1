"""Row-wise classifiers: composites, regimes, concordance, alignment, hypotheses and position labels."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eleven regimes by the signs of the daily and four-hour trend, the five they reduce to, hypotheses by leading state.
REGIMES = {
    (1, 1): "sync_bullish", (1, -1): "bullish_retracing", (1, 0): "bullish_consolidating", (0, 1): "bullish_emerging", (0, 0): "macro_ranging",
    (0, -1): "bearish_emerging", (-1, 0): "bearish_consolidating", (-1, 1): "bearish_retracing", (-1, -1): "sync_bearish",
}
REDUCED = {
    "sync_strong_bullish": "full_bullish", "sync_bullish": "full_bullish", "bullish_retracing": "bullish_transition", "bullish_consolidating": "bullish_transition", "bullish_emerging": "bullish_transition",
    "macro_ranging": "macro_ranging", "bearish_emerging": "bearish_transition", "bearish_consolidating": "bearish_transition", "bearish_retracing": "bearish_transition", "sync_bearish": "full_bearish", "sync_strong_bearish": "full_bearish",
}
HYPOTHESES = {"strong_bullish": "strong_long", "bullish": "weak_long", "neutral": "no_setup", "bearish": "weak_short", "strong_bearish": "strong_short"}
STATE_VALUES = {"strong_bullish": 2, "bullish": 1, "neutral": 0, "bearish": -1, "strong_bearish": -2}


def mapped(x: Column, table: dict[str, object], default: Column | None = None) -> Column:
    out = reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(None)))
    return out.otherwise(default) if default is not None else out


def composite(signals: dict[str, tuple[int, float]], norm: str = "abs") -> Column:
    """Signed weighted score of -2..2 signals, clipped to [-1, 1]. norm "half": over twice the weights, so 2 everywhere is 1; "abs": over the weights."""
    total = reduce(add, (F.col(c) * F.lit(float(p * w)) for c, (p, w) in signals.items()))
    scale = sum(abs(w) for _, w in signals.values()) * (2 if norm == "half" else 1)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.lit(float(scale))))


def five_states(score: Column, neutral: float = 0.05, strong: float = 0.15, neutral_down: float | None = None, strong_down: float | None = None) -> Column:
    """Symmetric, or asymmetric with thresholds of its own below zero; inclusive on both sides."""
    down, far = neutral if neutral_down is None else neutral_down, strong if strong_down is None else strong_down
    return F.when(score >= strong, "strong_bullish").when(score >= neutral, "bullish").when(score <= -far, "strong_bearish").when(score <= -down, "bearish").otherwise("neutral")


def regime(daily: Column, four_hour: Column) -> Column:
    """Eleven regimes of two trend signals in -2..2; null is ranging; strong only where both agree and the daily is strong."""
    d, q = F.signum(daily), F.signum(four_hour)
    out = F.when(daily.isNull() | four_hour.isNull(), "macro_ranging").when((daily >= 2) & (four_hour > 0), "sync_strong_bullish").when((daily <= -2) & (four_hour < 0), "sync_strong_bearish")
    for (x, y), name in REGIMES.items():
        out = out.when((d == x) & (q == y), name)
    return out


def reduced_regime(name: Column) -> Column:
    return mapped(name, REDUCED, F.lit("macro_ranging"))


def concordance_score(*signals: Column) -> Column:
    """[0, 1] from three or four timeframes, longest first."""
    weights = {3: (60, 30, 10), 4: (50, 25, 15, 10)}[len(signals)]
    return (reduce(add, (F.coalesce(s, F.lit(0)) * w for s, w in zip(signals, weights, strict=True))) + 200) / 400


def evidence_state(score: Column) -> Column:
    return F.when(score >= 0.8, "strong").when(score >= 0.6, "moderate").when(score >= 0.4, "mixed").otherwise("weak")


def alignment(coincident: Column, confirming: Column, high: float = 0.10, low: float = -0.10) -> dict[str, Column]:
    """score, category and confidence of two five-state columns."""
    c, f = mapped(coincident, STATE_VALUES).cast("double"), mapped(confirming, STATE_VALUES).cast("double")
    score = c * f / 4
    category = F.when((c == 0) & (f == 0), "NEUTRAL").when((c == 0) | (f == 0), "PARTIAL").when(F.signum(c) == F.signum(f), "FULL_ALIGNED").otherwise("OPPOSING")
    return {"alignment": score, "category": category, "confidence": F.when(score >= high, "high").when(score <= low, "low").otherwise("medium")}


def hypothesis(leading_state: Column) -> Column:
    return mapped(leading_state, HYPOTHESES, F.lit("no_setup"))


def momentum_label(change: Column, band: float = 0.005) -> Column:
    return F.when(change > band, "bullish").when(change < -band, "bearish").otherwise("neutral")


def volatility_label(ratio: Column, low: float = 0.8, high: float = 1.2) -> Column:
    """ratio of the current to the entry ATR; null or 0 counts as 1."""
    r = F.when(ratio.isNull() | (ratio == 0), F.lit(1.0)).otherwise(ratio)
    return F.when(r < low, "low_vol").when(r > high, "high_vol").otherwise("normal")


def time_bucket(minutes: Column) -> Column:
    return F.when(minutes < 60, "0-1h").when(minutes < 240, "1-4h").when(minutes < 720, "4-12h").otherwise("12h+")


def pnl_bucket(pnl: Column, band: float = 0.25) -> Column:
    return F.when(pnl < -band, "losing").when(pnl > band, "winning").otherwise("breakeven")


def delta_state(delta: Column, threshold: float) -> Column:
    return F.when(delta >= threshold, "strengthening").when(delta <= -threshold, "weakening").otherwise("stable")


def direction_label(outcome: Column, direction: Column) -> Column:
    """target_hit, stoploss_hit or timeout of an outcome such as up_strong for a long or short."""
    long_, up, down = direction == "long", outcome.startswith("up"), outcome.startswith("down")
    return F.when((long_ & up) | (~long_ & down), "target_hit").when((long_ & down) | (~long_ & up), "stoploss_hit").otherwise("timeout")


def concordance_scenario(*signals: Column) -> Column:
    """Eight scenarios from the signs of three or four timeframes. Without an opposing sign all but one agreeing is strong and
    half of them moderate; with one, the larger side is weak and a draw conflicted."""
    up = reduce(add, (F.coalesce(s > 0, F.lit(False)).cast("int") for s in signals))
    down = reduce(add, (F.coalesce(s < 0, F.lit(False)).cast("int") for s in signals))
    most, half = len(signals) - 1, len(signals) // 2
    out = F.when((up > 0) & (up == down), "conflicted").when((down > 0) & (up > down), "weak_bullish").when((up > 0) & (down > up), "weak_bearish")
    for side, name in ((up, "bullish"), (down, "bearish")):
        out = out.when(side >= most, f"strong_{name}").when(side >= half, f"moderate_{name}")
    return out.otherwise("neutral")


#: Size multipliers by volatility.
SIZE = {"low_vol": 1.2, "normal": 1.0, "high_vol": 0.5}


def position_decision(momentum: Column, volatility: Column, exit_: Column, prediction: Column, exit_sure: Column | None = None, momentum_sure: Column | None = None, exit_least: float = 0.5, momentum_least: float = 0.5) -> dict[str, Column]:
    """action, confidence and size: the first rule that applies. Confidences, where given, gate the two closing rules."""
    size = mapped(volatility, SIZE, F.lit(1.0)).cast("double")
    gate = lambda sure, least: F.lit(True) if sure is None else (sure.isNull() | (sure >= least))
    rules = [
        ((exit_ == "exit_now") & gate(exit_sure, exit_least), "CLOSE", 0.9, 1.0),
        ((momentum == "bearish") & prediction.isin("stoploss_hit", "timeout") & gate(momentum_sure, momentum_least), "CLOSE", 0.8, 1.0),
        ((prediction == "target_hit") & (momentum != "bearish"), "HOLD", 0.7, 1.0),
        ((momentum == "bullish") & (exit_ == "extend"), "SCALE_IN", 0.6, 0.5),
        ((momentum == "bearish") & (exit_ == "hold"), "SCALE_OUT", 0.6, 0.5),
    ]
    pick = lambda at, rest: reduce(lambda c, r: c.when(r[0], F.lit(r[at])), rules, F.when(F.lit(False), F.lit(rest))).otherwise(F.lit(rest))
    return {"action": pick(1, "HOLD"), "confidence": pick(2, 0.5), "size": size * pick(3, 1.0)}


def exit_label(pnl: Column, most: Column, threshold: float = 0.8) -> Column:
    """exit_now where the share of the best profit of the event that is captured reaches the threshold, extend where as much is
    left, else hold. The share lies from 0 to 1 and is 0.5 where it is unknown (no best profit or one of 0)."""
    captured = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(pnl, most), F.lit(0.5))))
    return F.when(captured >= threshold, "exit_now").when(1 - captured >= threshold, "extend").otherwise("hold")


def confidence_label(outcome: Column, direction: Column) -> Column:
    """high for a strong outcome in the position's direction, medium for a weak one, low otherwise."""
    with_ = direction_label(outcome, direction) == "target_hit"
    return F.when(with_ & outcome.endswith("strong"), "high").when(with_, "medium").otherwise("low")
