"""Portfolio construction: buffered selection, capped weights, risk-aware weights and lots.

A decision date's candidates are one small group; all dates run in parallel. Greedy steps go by score,
ties by code, so results do not depend on how rows arrive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Construction:
    """count: names wanted; buy_rank and sell_rank: the buffer; caps are weights of the whole account."""

    equity: float = 0.95
    count: int = 20
    buy_rank: int = 20
    sell_rank: int = 40
    stock_cap: float = 0.10
    group_cap: float = 0.30
    temperature: float = 1.0
    volatility_power: float = 0.5
    least_volatility: float = 0.10
    missing_volatility: float = 0.30


def sparse_selection(orders: DataFrame, by: list[str], gross: str, key: str, required: str, most: int) -> DataFrame:
    """Largest orders first, while what comes before is less than required, at most ``most`` of them."""
    w = Window.partitionBy(*by).orderBy(F.desc(gross), key)
    out = orders.withColumn("before", F.coalesce(F.sum(gross).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("k", F.row_number().over(w))
    return out.where((F.col("before") < F.col(required)) & (F.col("k") <= most))


def buffered_selection(rank: np.ndarray, group: np.ndarray, held: np.ndarray, spec: Construction) -> np.ndarray:
    """Indices chosen from rows in rank order: held names within the sell rank, new ones within the buy rank, then more, under group counts."""
    wanted = min(max(spec.count, math.ceil(spec.equity / spec.stock_cap)), len(rank))
    per_group = max(1, math.ceil(wanted * spec.group_cap / spec.equity - 1e-9)) if spec.group_cap > 0 else 0
    chosen: list[int] = []
    count: dict = {}
    for allowed in (held & (rank <= spec.sell_rank), ~held & (rank <= spec.buy_rank), np.ones(len(rank), bool)):
        for i in np.flatnonzero(allowed):
            if len(chosen) >= wanted:
                break
            if i not in chosen and count.get(group[i], 0) < per_group:
                chosen.append(int(i))
                count[group[i]] = count.get(group[i], 0) + 1
    return np.array(sorted(chosen), int)


def cap_and_redistribute(raw: np.ndarray, group: np.ndarray, total: float, stock_cap: np.ndarray | float, group_cap: np.ndarray | float, rounds: int = 100) -> np.ndarray:
    """Weights in proportion to ``raw`` with sums as near ``total`` as the caps allow; what a cap cuts off goes to names with room."""
    n = len(raw)
    cap = np.broadcast_to(np.asarray(stock_cap, float), n)
    codes, of = np.unique(group.astype(str), return_inverse=True)
    limit = np.broadcast_to(np.asarray(group_cap, float), len(codes))
    w = raw / raw.sum() * total if raw.sum() > 0 else np.zeros(n)
    for _ in range(rounds):
        before = w
        w = np.minimum(w, cap)
        sums = np.bincount(of, w, len(codes))
        w = w * np.where(sums > limit, limit / np.maximum(sums, 1e-300), 1.0)[of]
        missing = total - w.sum()
        room = np.minimum(cap - w, (limit - np.bincount(of, w, len(codes)))[of])
        open_ = room > 1e-12
        if missing <= 1e-8 or not open_.any():
            break
        share = np.where(open_, raw, 0.0)
        add = np.minimum(missing * share / max(share.sum(), 1e-300), np.maximum(cap - w, 0))
        own = np.bincount(of, add, len(codes))
        left = limit - np.bincount(of, w, len(codes))
        w = w + add * np.where(own > left, np.maximum(left, 0) / np.maximum(own, 1e-300), 1.0)[of]
        if np.abs(w - before).sum() < 1e-9:
            break
    return w


def score_weights(score: np.ndarray, volatility: np.ndarray, spec: Construction) -> np.ndarray:
    """exp of scaled scores over a power of volatility; missing volatility is the median of the others."""
    known = volatility[np.isfinite(volatility)]
    vol = np.where(np.isfinite(volatility), volatility, np.median(known) if len(known) else spec.missing_volatility)
    raw = np.exp(np.clip((score - score.max()) / spec.temperature, -30, 30))
    return raw / np.maximum(vol, spec.least_volatility) ** spec.volatility_power


def target_weights(candidates: DataFrame, spec: Construction = Construction()) -> DataFrame:
    """(decision_date, code, weight) from candidates (decision_date, code, score, volatility, industry_group, held).

    Only rows that can be chosen come to Python: a name of a group is taken over all when those of its group before it were, so at most ``wanted``
    of a group, or by a rank of the buffer; and what is passed over lies in groups that are full, of which there are ``wanted`` at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        df = pdf.dropna(subset=["score"]).sort_values(["score", "code"], ascending=[False, True]).reset_index(drop=True)
        if df.empty:
            return pd.DataFrame(columns=["decision_date", "code", "weight"], dtype=object)
        group = df["industry_group"].fillna("UNKNOWN").to_numpy()
        at = buffered_selection(np.arange(1, len(df) + 1), group, df["held"].fillna(False).to_numpy(bool), spec)
        raw = score_weights(df["score"].to_numpy(float)[at], df["volatility"].to_numpy(float)[at], spec)
        w = cap_and_redistribute(raw, group[at], spec.equity, spec.stock_cap, spec.group_cap)
        return pd.DataFrame({"decision_date": df["decision_date"].iloc[0], "code": df["code"].to_numpy()[at], "weight": w})

    wanted = max(spec.count, math.ceil(spec.equity / spec.stock_cap))
    most = max(wanted, spec.buy_rank, spec.sell_rank)
    rows = candidates.select("decision_date", F.col("code").cast("string").alias("code"), "score", "volatility", "industry_group", "held")
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))).withColumn("_group", F.coalesce(F.col("industry_group").cast("string"), F.lit("UNKNOWN")))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "code"))
    rows = rows.withColumn("_k", best("decision_date", "_group")).where(F.col("_k") <= most).withColumn("_k", best("decision_date")).where(F.col("_k") <= most * (wanted + 1))
    return rows.drop("_k", "_group").groupBy("decision_date").applyInPandas(run, "decision_date date, code string, weight double")


def round_to_lots(weight: np.ndarray, price: np.ndarray, low: np.ndarray, step: np.ndarray, value: float) -> np.ndarray:
    """Shares in legal lots below the targets, then one lot more at a time where the rest is largest and money is left."""
    wanted = weight * value / price
    shares = np.where(wanted >= low, low + np.floor((wanted - low) / step + 1e-9) * step, 0).astype(np.int64)
    left = weight.sum() * value - (shares * price).sum()
    rest = (wanted - shares) * price
    for i in np.lexsort((np.arange(len(rest)), -rest)):
        more = step[i] if shares[i] else low[i]
        if rest[i] > 0 and more * price[i] <= left + 1e-9:
            shares[i] += more
            left -= more * price[i]
    return shares


def lots(targets: DataFrame, value: float) -> DataFrame:
    """(decision_date, code, shares) from targets with weight, price, min_lot and lot_step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        df = pdf[(pdf["price"] > 0) & (pdf["weight"] > 0)].sort_values(["weight", "code"], ascending=[False, True])
        shares = round_to_lots(*(df[c].to_numpy(float) for c in ("weight", "price", "min_lot", "lot_step")), value) if len(df) else []
        return pd.DataFrame({"decision_date": df["decision_date"], "code": df["code"], "shares": shares})

    rows = targets.select("decision_date", "code", "weight", "price", "min_lot", "lot_step")
    return rows.groupBy("decision_date").applyInPandas(run, "decision_date date, code string, shares long")


def satellite_allocation(desired: np.ndarray, raw: np.ndarray, leader: np.ndarray, group: np.ndarray, fraction: float, total: float, stock_cap: np.ndarray | float, group_cap: np.ndarray | float) -> np.ndarray:
    """The wanted weights with a fraction (half at most) allocated among names of the leading groups alone, both under the caps."""
    fraction = min(max(fraction, 0.0), 0.5)
    side = np.where(leader, np.maximum(np.nan_to_num(raw), 0.0), 0.0)
    if not len(desired) or fraction <= 0 or side.sum() <= 0:
        return desired
    own = cap_and_redistribute(side, group, total, stock_cap, group_cap)
    return cap_and_redistribute((1 - fraction) * desired + fraction * own, group, total, stock_cap, group_cap)


def satellite_weights(targets: DataFrame, total: float, stock_cap: float, group_cap: float) -> DataFrame:
    """(decision_date, code, weight) from targets (decision_date, code, weight, raw, leader, satellite_weight, industry_group); the greatest satellite weight of a date counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        df = pdf.sort_values("code")
        fraction = df["satellite_weight"].max()
        w = satellite_allocation(df["weight"].to_numpy(float), df["raw"].to_numpy(float), df["leader"].fillna(False).to_numpy(bool), df["industry_group"].fillna("UNKNOWN").to_numpy(), 0.0 if pd.isna(fraction) else float(fraction), total, stock_cap, group_cap)
        return pd.DataFrame({"decision_date": df["decision_date"], "code": df["code"], "weight": w})

    rows = targets.select("decision_date", F.col("code").cast("string"), "weight", "raw", "leader", "satellite_weight", "industry_group")
    return rows.groupBy("decision_date").applyInPandas(run, f"decision_date {dict(targets.dtypes)['decision_date']}, code string, weight double")


@dataclass(frozen=True)
class Preferences:
    """leaders: names of leading groups, one a group, that are taken first; defensive: groups that together have at most ``defensive_fraction`` of the names, and
    each at most ``defensive_names`` (0: no limit); group_caps: caps of groups that differ from the common one.
    """

    leaders: int = 0
    defensive: tuple[str, ...] = ()
    defensive_fraction: float = 1.0
    defensive_names: int = 0
    group_caps: tuple[tuple[str, float], ...] = ()


def _pick(lot: np.ndarray, group: np.ndarray, code: np.ndarray, leader: np.ndarray, most: int, budget: float, value: float, spec: Construction, prefer: Preferences) -> list[int]:
    """Places of the names chosen, in the order of choice; all arrays are in order of preference."""
    afforded, reserved = 0, 0.0
    for x in lot:
        if afforded < most and reserved + x <= budget + 1e-8:
            afforded, reserved = afforded + 1, reserved + x
    caps, guarded = dict(prefer.group_caps), {g.strip().upper() for g in prefer.defensive if g.strip()}
    cap = lambda g: max(0.0, caps.get(g, spec.group_cap))

    def names_of(g: str) -> int:
        if cap(g) <= 0:
            return 0
        own = max(1, math.ceil(afforded * cap(g) / max(spec.equity, 1e-8) - 1e-9))
        return min(own, prefer.defensive_names) if prefer.defensive_names > 0 and g.upper() in guarded else own

    fraction = min(max(prefer.defensive_fraction, 0.0), 1.0)
    most_guarded = math.floor(afforded * fraction + 1e-9) if guarded and fraction < 1 else afforded
    chosen: list[int] = []
    names: dict[str, int] = {}
    money: dict[str, float] = {}
    n_guarded, reserved = 0, 0.0

    def take(i: int) -> None:
        nonlocal n_guarded, reserved
        g, x = group[i], lot[i]
        if names.get(g, 0) < names_of(g) and reserved + x <= budget + 1e-8 and money.get(g, 0.0) + x <= value * cap(g) + 1e-8:
            chosen.append(i)
            names[g], money[g], reserved = names.get(g, 0) + 1, money.get(g, 0.0) + x, reserved + x
            n_guarded += g.upper() in guarded

    first: dict[str, int] = {}
    for i in np.flatnonzero(leader > 0) if prefer.leaders > 0 else ():
        first.setdefault(group[i], int(i))
    for i in sorted(first.values(), key=lambda i: (leader[i], code[i])):
        if len(chosen) < min(prefer.leaders, afforded):
            take(i)
    for i in range(len(lot)):
        if len(chosen) >= afforded:
            break
        if i not in chosen and not (group[i].upper() in guarded and n_guarded >= most_guarded):
            take(i)
    return chosen


def lot_aware_selection(candidates: DataFrame, value: float, spec: Construction = Construction(), least_holdings: int = 5, slippage_bps: float = 0.0, prefer: Preferences = Preferences()) -> DataFrame:
    """(decision_date, code, pick, minimum_weight): names whose smallest legal order fits the account.

    ``candidates``: decision_date, code, rank, held, close, min_lot, industry_group; if they are there, retention_rank (which decides for held names)
    and leader_rank (of a leading group, from 1; null or 0 for others). Held names within the sell rank
    come first, then those within the buy rank, then the rest; before all of them the leaders that ``prefer`` asks for. A smallest order above the budget of
    ``least_holdings`` equal parts is left out. How many can be afforded sets how many a group may have; both
    a group's smallest orders and all together stay within their money. What only filters, orders and counts
    is windows; the greedy pass over a date's names is a grouped function, as each step hangs on the ones before.
    """
    budget = max(0.0, value * spec.equity)
    count = F.least(F.lit(spec.count), F.count("*").over(Window.partitionBy("decision_date")))
    keep = F.coalesce("retention_rank", "rank") if "retention_rank" in candidates.columns else F.col("rank")
    leader = F.coalesce(F.col("leader_rank").cast("int"), F.lit(0)) if "leader_rank" in candidates.columns else F.lit(0)
    held = F.coalesce("held", F.lit(False)) & (keep <= spec.sell_rank)
    place = F.when(held, 0).when(F.col("rank") <= spec.buy_rank, 1).otherwise(2)
    rows = candidates.withColumns({"_count": count, "_place": place, "_order": F.when(held, keep).otherwise(F.col("rank")), "_leader": leader, "_lot": F.col("min_lot") * F.col("close") * (1 + slippage_bps / 1e4)}).where(F.col("close") > 0)
    rows = rows.where(F.col("_lot") <= budget / F.least(F.col("_count"), F.lit(max(1, least_holdings))) + 1e-8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        df = pdf.sort_values(["_place", "_order", "code"])
        lot, group = df["_lot"].to_numpy(float), df["industry_group"].fillna("UNKNOWN").to_numpy()
        chosen = _pick(lot, group, df["code"].to_numpy(), df["_leader"].to_numpy(int), int(df["_count"].iloc[0]), budget, value, spec, prefer)
        return pd.DataFrame({"decision_date": df["decision_date"].iloc[chosen], "code": df["code"].iloc[chosen], "pick": range(1, len(chosen) + 1), "minimum_weight": lot[chosen] / value})

    kind = dict(candidates.dtypes)["decision_date"]
    rows = rows.select("decision_date", F.col("code").cast("string"), "industry_group", "_count", "_place", "_order", "_leader", "_lot")
    return rows.groupBy("decision_date").applyInPandas(run, f"decision_date {kind}, code string, pick long, minimum_weight double")


def keep_within_band(target: DataFrame, current: DataFrame, by: list[str], band: float) -> DataFrame:
    """Current weights where the target is within the band, the target elsewhere."""
    both = target.join(current.withColumnRenamed("weight", "_now"), by, "full")
    t, n = F.coalesce("weight", F.lit(0.0)), F.coalesce("_now", F.lit(0.0))
    return both.select(*by, F.when(F.abs(t - n) < band, n).otherwise(t).alias("weight"))


def industry_budgets(market_share: DataFrame, equity: float, absolute: float, deviation: float, unknown: float) -> DataFrame:
    """Cap of each group: its market share plus a deviation, under an absolute cap; UNKNOWN has its own."""
    cap = F.least(F.lit(absolute), (F.col("market_weight") + deviation) * equity)
    return market_share.withColumn("group_cap", F.when(F.col("industry_group") == "UNKNOWN", unknown).otherwise(cap))
