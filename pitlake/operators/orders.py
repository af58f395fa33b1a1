"""Integer orders of an account: legal lots near the target weights under exact fees, and the guard of replacement orders.

Options, their fees by side, exchange, board and day, and their cash flows are columns, made before any grouping. Only the
choice among an account's few dozen names is a grouped step, over numbers that are already there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions import trading as T


@dataclass(frozen=True)
class Search:
    """stock_cap: weight, or 1.35 times a name's target if that is more; reach: lots beside the wanted number; tracking, cash, cost: penalties;
    commission, minimum: the broker's; rounds: of the coordinate search; nodes: of the exact one at most, 0 for none.
    """

    stock_cap: float = 0.10
    reach: int = 4
    tracking: float = 1.0
    cash: float = 0.75
    cost: float = 2.0
    commission: float = 0.0
    minimum: float = 0.0
    rounds: int = 12
    nodes: int = 200_000


def lot_options(code: Column, weight: Column, held: Column, price: Column, value: Column, spec: Search) -> Column:
    """Sorted numbers of shares a name may end with: the least lot, the cap, what is held, and lots around the wanted number."""
    low, step = T.minimum_lot(code), T.lot_increment(code)
    down = lambda x: (low + F.greatest(F.lit(0), F.floor((x - low) / step)) * step).cast("long")
    wanted = F.floor(weight * value / price)
    cap = down(F.floor(F.greatest(F.lit(spec.stock_cap), weight * 1.35) * value / price))
    near = [F.when((x >= low) & (x <= cap), x.cast("long")) for x in (down(wanted) + k * step for k in range(-spec.reach, spec.reach + 1))]
    kept = F.when(held >= low, down(held))
    return F.array_sort(F.array_compact(F.array_distinct(F.array(low.cast("long"), cap, kept, *near))))


def priced_options(targets: DataFrame, by: list[str], spec: Search) -> DataFrame:
    """A row for each option: by, code, weight, shares, flow (cash after fees), fee, own (the option's weight), and the account's value, cash and day.

    ``targets``: by, code, weight, held, price, value, cash, day; names held without a target have weight 0 and end with no shares;
    names without a price cannot be traded: they are left out, and the weight of those held is kept back from the cash wanted.
    """
    held, price = F.coalesce("held", F.lit(0)).cast("long"), F.col("price")
    options = F.when(F.col("weight") > 0, lot_options(F.col("code"), F.col("weight"), held, price, F.col("value"), spec)).otherwise(F.array(F.lit(0).cast("long")))
    rows = targets.where(price > 0).withColumn("held", held).withColumn("shares", F.explode(options))
    change = F.col("shares") - F.col("held")
    side, gross = F.when(change > 0, "BUY").otherwise("SELL"), F.abs(change) * price
    fee = F.when(change != 0, T.trade_cost(gross, side, F.col("code"), F.col("day"), F.abs(change), spec.commission, spec.minimum)).otherwise(0.0)
    return rows.withColumn("fee", fee).withColumn("flow", F.when(change > 0, -gross).otherwise(gross) - F.col("fee")).withColumn("own", F.col("shares") * price / F.col("value"))


class _Account:
    """One account's names with their options, and the score of a choice."""

    def __init__(self, pdf: pd.DataFrame, spec: Search):
        self.spec, self.value = spec, float(pdf["value"].iloc[0])
        first = pdf.drop_duplicates("code")
        aimed = first[first["weight"] > 0].sort_values(["weight", "code"], ascending=[False, True])
        gone = first[first["weight"] <= 0]
        self.cash = float(pdf["cash"].iloc[0]) + float(gone["flow"].sum())
        self.fees = float(gone["fee"].sum())
        self.codes = list(aimed["code"])
        self.weights = aimed["weight"].to_numpy(float)
        self.wanted = self.value * max(0.0, 1 - self.weights.sum() - float(pdf["kept_back"].iloc[0]))
        parts = {c: g.sort_values("shares") for c, g in pdf[pdf["weight"] > 0].groupby("code")}
        self.shares = [parts[c]["shares"].to_numpy(np.int64) for c in self.codes]
        self.flow = [parts[c]["flow"].to_numpy(float) for c in self.codes]
        norm = max(float((self.weights**2).sum()), 1e-8)
        fee = [parts[c]["fee"].to_numpy(float) for c in self.codes]
        #: What an option adds to the score but for the cash.
        self.adds = [spec.tracking * (parts[c]["own"].to_numpy(float) - w) ** 2 / norm + spec.cost * f / self.value for c, w, f in zip(self.codes, self.weights, fee, strict=True)]

    def score(self, adds: float, cash: float) -> float:
        if cash < -1e-7:
            return np.inf
        return adds + self.spec.cash * ((cash - self.wanted) / self.value) ** 2 + self.spec.cost * self.fees / self.value

    def coordinate(self) -> tuple[np.ndarray, float]:
        """From the least lots on, name by name the option of the best score, until none changes."""
        at = np.zeros(len(self.codes), int)
        adds, cash = sum(a[0] for a in self.adds), self.cash + sum(f[0] for f in self.flow)
        best = self.score(adds, cash)
        for _ in range(max(1, self.spec.rounds) if np.isfinite(best) else 0):
            changed = False
            for i, (own_adds, own_flow) in enumerate(zip(self.adds, self.flow, strict=True)):
                rest_adds, rest_cash = adds - own_adds[at[i]], cash - own_flow[at[i]]
                take = at[i]
                for k in range(len(own_adds)):
                    here = self.score(rest_adds + own_adds[k], rest_cash + own_flow[k]) if k != at[i] else best
                    if here + 1e-12 < best:
                        take, best = k, here
                if take != at[i]:
                    at[i], changed = take, True
                    adds, cash = rest_adds + own_adds[take], rest_cash + own_flow[take]
            if not changed:
                break
        return at, best

    def exact(self, at: np.ndarray, best: float) -> tuple[np.ndarray, float, bool]:
        """Branch and bound over all choices; the last value says whether it was finished within ``nodes``.

        A branch ends where its score so far, the least the rest can add, and the nearest the rest's cash can come
        to what is wanted are no better than the best choice known, or where no rest leaves any cash.
        """
        n = len(self.codes)
        least = np.append(np.cumsum([a.min() for a in self.adds][::-1])[::-1], 0.0)
        most = np.append(np.cumsum([f.max() for f in self.flow][::-1])[::-1], 0.0)
        fewest = np.append(np.cumsum([f.min() for f in self.flow][::-1])[::-1], 0.0)
        order = [np.argsort(a, kind="stable") for a in self.adds]
        found, left = at.copy(), self.spec.nodes

        def visit(i: int, adds: float, cash: float, chosen: list[int]) -> bool:
            nonlocal best, found, left
            left -= 1
            if left < 0:
                return False
            if i == n:
                here = self.score(adds, cash)
                if here < best - 1e-15:
                    best, found = here, np.array(chosen)
                return True
            low, high = cash + fewest[i], cash + most[i]
            off = max(0.0, low - self.wanted, self.wanted - high) / self.value
            if high < -1e-7 or adds + least[i] + self.spec.cash * off**2 + self.spec.cost * self.fees / self.value >= best - 1e-15:
                return True
            return all(visit(i + 1, adds + self.adds[i][k], cash + self.flow[i][k], [*chosen, k]) for k in order[i])

        finished = visit(0, 0.0, self.cash, [])
        return found, best, finished


def integer_orders(targets: DataFrame, by: list[str], spec: Search = Search()) -> DataFrame:
    """(by, code, shares, objective, search): the lots of each account, for the names with a target and a price.

    ``search`` is ``exact`` where branch and bound has seen all choices, ``coordinate`` where it was stopped or not asked for; accounts that
    cannot pay their least lots have ``infeasible`` and no shares. See ``priced_options`` for ``targets``.
    """
    unpriced = F.when(~(F.coalesce("price", F.lit(0.0)) > 0) & (F.coalesce("held", F.lit(0)) > 0), F.col("weight")).otherwise(0.0)
    kept = targets.groupBy(*by).agg(F.sum(unpriced).alias("kept_back"))
    rows = priced_options(targets, by, spec).join(kept, by).select(*by, "code", "weight", "shares", "flow", "fee", "own", "value", "cash", "kept_back")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        account = _Account(pdf, spec)
        at, best = account.coordinate()
        how = "coordinate"
        if not np.isfinite(best):
            how = "infeasible"
        if spec.nodes:
            at, best, finished = account.exact(at, best)
            how = "exact" if finished and np.isfinite(best) else "coordinate" if np.isfinite(best) else "infeasible"
        shares = [int(s[k]) for s, k in zip(account.shares, at, strict=True)] if np.isfinite(best) else [None] * len(at)
        out = pd.DataFrame({"code": account.codes, "shares": pd.array(shares, "Int64"), "objective": best if np.isfinite(best) else None, "search": how})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    kinds = dict(targets.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "code string, shares long, objective double, search string"]))


def _repair(pdf: pd.DataFrame, groups: set[str], fraction: float, stock_cap: float) -> tuple[np.ndarray, int, int]:
    """Shares of one account after its repair, and the lots taken away and added."""
    value = float(pdf["value"].iloc[0])
    price, target = pdf["price"].to_numpy(float), np.maximum(pdf["weight"].fillna(0.0).to_numpy(float), 0.0)
    low, step = pdf["low"].to_numpy(np.int64), pdf["step"].to_numpy(np.int64)
    shares = np.maximum(pdf["shares"].fillna(0).to_numpy(np.int64), 0)
    inside = pdf["group"].isin(groups).to_numpy()
    traded = np.isfinite(price) & (price > 0)
    worth = np.where(traded, price, 0.0)
    budget = value * target.sum()
    taken = added = 0
    if not groups or value <= 0 or fraction >= 1 or (shares * worth)[inside].sum() <= budget * fraction + 1e-8:
        return shares, 0, 0
    off = lambda n: (n * worth / value - target) ** 2
    while (shares * worth)[inside].sum() > budget * fraction + 1e-8:
        less = np.where(shares <= low, 0, shares - step)
        freed = (shares - less) * worth
        cost = np.where(inside & traded & (shares > 0), (off(less) - off(shares)) / np.maximum(freed, 1e-8), np.inf)
        i = int(np.argmin(cost))  # rows are in order of their codes, so ties go to the first
        if not np.isfinite(cost[i]):
            break
        shares[i], taken = less[i], taken + 1
    while True:
        left = budget - (shares * worth).sum()
        more = np.where(shares <= 0, low, step)
        lot = more * worth
        gain = off(shares) - off(shares + more)
        fits = ~inside & traded & (target > 0) & (lot <= left + 1e-8) & ((shares + more) * worth / value <= np.maximum(stock_cap, target * 1.35) + 1e-8) & (gain > 1e-12)
        cost = np.where(fits, -gain / np.where(lot > 0, lot, 1.0), np.inf)
        i = int(np.argmin(cost)) if len(cost) and left > 0 else -1
        if i < 0 or not np.isfinite(cost[i]):
            return shares, taken, added
        shares[i], added = shares[i] + more[i], added + 1


def repaired_groups(targets: DataFrame, by: list[str], groups: list[str], fraction: float, stock_cap: float) -> DataFrame:
    """(by, code, shares, taken, added): rounded shares brought back under a cap on some groups together, a lot at a time.

    ``targets``: by, code, weight, shares, price, value, group. While the groups hold more than ``fraction`` of the wanted equity, the lot goes whose loss costs least
    nearness a unit of money; then lots of other names come that bring most nearness, while money and the cap on a name (1.35 times its target, if more) allow.
    Names without a price keep their shares and count for nothing. An account's few dozen names are one group.
    """
    kinds = dict(targets.dtypes)
    rows = targets.select(*by, F.col("code").cast("string").alias("code"), "weight", "shares", F.col("price").cast("double").alias("price"), "value", F.upper(F.trim("group")).alias("group")).withColumns({"low": T.minimum_lot(F.col("code")), "step": T.lot_increment(F.col("code"))})
    wanted = {g.strip().upper() for g in groups if g.strip()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code").reset_index(drop=True)
        shares, taken, added = _repair(pdf, wanted, min(max(fraction, 0.0), 1.0), stock_cap)
        return pdf[[*by, "code"]].assign(shares=shares, taken=taken, added=added)

    return rows.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "code string, shares long, taken long, added long"]))


def guarded(orders: DataFrame, by: list[str], deployed: float = 0.01) -> DataFrame:
    """``orders`` with ``kept``: replacement legs that would change net exposure beyond what is wanted wait.

    ``orders``: by, id, side, gross, actionable, mode, transition, rank, target_weight, and per account current, target (equity weights) and value.
    The wanted net purchase is (target - current) * value. Where buys are wanted, sells are kept up to what buys leave over,
    and then buys up to the wanted amount and the sells kept; where sells are wanted, the other way round; where neither is, the larger side
    follows the smaller. A side is kept in order of priority, each order that brings its sum nearer to its budget; an account that holds next to
    nothing keeps all its buys. Orders that cannot be executed stay as they are. One fold over an account's sorted orders, without Python.
    """
    able = F.coalesce("actionable", F.lit(True)) & F.col("side").isin("BUY", "SELL")
    gross = F.greatest(F.coalesce("gross", F.lit(0.0)), F.lit(0.0))
    sell = F.col("side") == "SELL"
    far = float("inf")
    rank = F.when(F.isnan(F.col("rank").cast("double")), None).otherwise(F.col("rank").cast("double"))
    urgent = F.coalesce(F.upper("mode") == F.when(sell, "REDUCE").otherwise("INCREASE"), F.lit(False))
    exits = F.coalesce(F.upper("transition") == "EXIT", F.lit(False))
    item = F.struct(
        F.when(urgent, 0).otherwise(1).alias("a"), F.when(sell, F.when(exits, 0.0).otherwise(1.0)).otherwise(F.coalesce(rank, F.lit(far))).alias("b"),
        F.when(sell, F.coalesce(-rank, F.lit(-far))).otherwise(-F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("c"), F.when(sell, -gross).otherwise(gross).alias("d"), F.col("id").alias("id"), gross.alias("gross"),
    )
    own = orders.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(able & ~sell, item))).alias("buys"), F.array_sort(F.collect_list(F.when(able & sell, item))).alias("sells"), F.max("current").alias("_c"), F.max("target").alias("_t"), F.max("value").alias("_v"))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + x["gross"])

    def nearest(items: Column, budget: Column) -> Column:
        goal = F.greatest(budget, F.lit(0.0))
        none = F.filter(F.transform(items, lambda x: x["id"]), lambda x: F.lit(False))

        def step(s: Column, x: Column) -> Column:
            better = (x["gross"] > 0) & (F.abs(goal - (s["used"] + x["gross"])) + 1e-8 < F.abs(goal - s["used"]))
            return F.struct(F.when(better, s["used"] + x["gross"]).otherwise(s["used"]).alias("used"), F.when(better, F.concat(s["ids"], F.array(x["id"]))).otherwise(s["ids"]).alias("ids"))

        return F.aggregate(items, F.struct(F.lit(0.0).alias("used"), none.alias("ids")), step)

    def everything(items: Column) -> Column:
        return F.struct(total(items).alias("used"), F.transform(items, lambda x: x["id"]).alias("ids"))

    buys, sells = F.col("buys"), F.col("sells")
    net = (F.greatest("_t", F.lit(0.0)) - F.greatest("_c", F.lit(0.0))) * F.greatest("_v", F.lit(0.0))
    own = own.withColumns({"_net": net, "_buy": total(buys), "_sell": total(sells)})
    # First the side that follows from totals, then the one that follows from what the first keeps.
    level = F.when(F.col("_buy") <= F.col("_sell"), everything(buys)).otherwise(nearest(buys, F.col("_sell")))
    own = own.withColumn("_first", F.when(F.col("_net") > 0, nearest(sells, F.col("_buy") - F.col("_net"))).when(F.col("_net") < 0, nearest(buys, F.col("_sell") + F.col("_net"))).otherwise(level))
    used = F.col("_first.used")
    bought = F.when(F.greatest("_c", F.lit(0.0)) <= deployed, everything(buys)).otherwise(nearest(buys, F.col("_net") + used))
    level = F.when(F.col("_buy") <= F.col("_sell"), nearest(sells, used)).otherwise(everything(sells))
    own = own.withColumn("_second", F.when(F.col("_net") > 0, bought).when(F.col("_net") < 0, nearest(sells, used - F.col("_net"))).otherwise(level))
    kept = own.select(*by, F.concat("_first.ids", "_second.ids").alias("_kept"))
    return orders.join(kept, by).withColumn("kept", ~able | F.array_contains("_kept", F.col("id"))).drop("_kept")
