"""Integer orders and the replacement guard against plain enumeration and a plain fold."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions import trading as T
from pitlake.operators import orders

COLUMNS = "account int, code string, weight double, held int, price double, value double, cash double, day date"


def accounts(rng, n):
    rows = []
    for a in range(n):
        codes = [f"{p}{a:03d}" for p in ("600", "300", "688", "830")]
        w = rng.dirichlet(np.ones(4)) * 0.9
        price, held = rng.uniform(3, 40, 4).round(2), rng.choice([0, 150, 300], 4)
        cash = float(rng.uniform(8000, 40000))
        value = cash + float((price * held).sum())
        rows += [(a, c, float(x), int(h), float(p), value, cash, dt.date(2022, 6, 1)) for c, x, h, p in zip(codes, w, held, price)]
        rows.append((a, f"601{a:03d}", 0.0, 100, 5.0, value, cash, dt.date(2022, 6, 1)))  # held, no target: sold
    return rows


def test_search_finds_the_best_of_all_lot_vectors(spark):
    df = spark.createDataFrame(accounts(np.random.default_rng(1), 6), COLUMNS)
    spec = orders.Search(stock_cap=0.3, reach=1, commission=0.0003, minimum=5.0)
    priced = orders.priced_options(df, ["account"], spec).toPandas()
    got = orders.integer_orders(df, ["account"], spec).toPandas()
    rough = orders.integer_orders(df, ["account"], orders.Search(stock_cap=0.3, reach=1, commission=0.0003, minimum=5.0, nodes=0)).toPandas()
    for a, own in priced.groupby("account"):
        gone, aimed = own[own["weight"] == 0], own[own["weight"] > 0]
        assert gone["shares"].tolist() == [0] and gone["flow"].item() == pytest.approx(500 - gone["fee"].item()) and gone["fee"].item() > 5
        value, w = own["value"].iloc[0], aimed.drop_duplicates("code")["weight"]
        best = (np.inf, None)
        for choice in itertools.product(*[list(g.itertuples()) for _, g in aimed.groupby("code")]):
            cash = own["cash"].iloc[0] + gone["flow"].sum() + sum(c.flow for c in choice)
            if cash < -1e-7:
                continue
            fees = gone["fee"].sum() + sum(c.fee for c in choice)
            score = sum((c.shares * c.price / value - c.weight) ** 2 for c in choice) / (w**2).sum() + 0.75 * ((cash - value * (1 - w.sum())) / value) ** 2 + 2 * fees / value
            best = min(best, (score, [(c.code, c.shares) for c in choice]))
        mine = got[got["account"] == a].sort_values("code")
        assert mine["objective"].iloc[0] == pytest.approx(best[0], abs=1e-12) and set(mine["search"]) == {"exact"}
        assert list(zip(mine["code"], mine["shares"])) == best[1]
        assert rough[rough["account"] == a]["objective"].iloc[0] >= best[0] - 1e-12


def test_fees_are_those_of_the_schedule(spark):
    df = spark.createDataFrame([(1, "600000", 0.5, 0, 10.0, 1e5, 1e5, dt.date(2022, 6, 1)), (1, "688001", 0.2, 500, 20.0, 1e5, 1e5, dt.date(2011, 6, 1))], COLUMNS)
    spec = orders.Search(commission=0.0003, minimum=5.0)
    rows = orders.priced_options(df, ["account"], spec).where("shares <> held")
    fee = T.trade_cost(F.abs(F.col("shares") - F.col("held")) * F.col("price"), F.when(F.col("shares") > F.col("held"), "BUY").otherwise("SELL"), F.col("code"), F.col("day"), F.abs(F.col("shares") - F.col("held")), 0.0003, 5.0)
    assert rows.where(F.abs(fee - F.col("fee")) > 1e-12).count() == 0 and rows.count() > 5
    star = orders.priced_options(df, ["account"], spec).where("code = '688001'").select("shares").toPandas()["shares"]
    assert star.min() == 200 and star.max() == 1350  # 1.35 times the target is more than the cap


def test_accounts_that_cannot_pay_and_unpriced_names(spark):
    rows = [(1, "600000", 0.9, 0, 300.0, 1000.0, 1000.0, dt.date(2022, 6, 1)), (2, "600000", 0.5, 0, 10.0, 10000.0, 9000.0, dt.date(2022, 6, 1)), (2, "600001", 0.4, 100, None, 10000.0, 9000.0, dt.date(2022, 6, 1))]
    got = {r.account: r for r in orders.integer_orders(spark.createDataFrame(rows, COLUMNS), ["account"]).collect()}
    assert got[1].search == "infeasible" and got[1].shares is None
    assert got[2].code == "600000" and got[2].shares == 500 and len(got) == 2
    assert orders.integer_orders(spark.createDataFrame([], COLUMNS), ["account"]).count() == 0
    stopped = orders.integer_orders(spark.createDataFrame(rows[1:], COLUMNS), ["account"], orders.Search(nodes=1)).first()
    assert stopped.search == "coordinate" and stopped.shares == 500


def test_groups_are_brought_back_under_their_cap(spark):
    rng = np.random.default_rng(5)
    rows = []
    for a in range(12):
        n = 9
        w = rng.dirichlet(np.ones(n)) * 0.9
        price = rng.uniform(3, 30, n)
        for i in range(n):
            shares = int(w[i] * 60000 / price[i] // 100 * 100) + (100 if i < 4 else 0)
            rows.append((a, f"60{i:04d}", float(w[i]), shares, float(price[i]) if i != 8 else None, 60000.0, ["bank", "Coal", "tech"][i % 3]))
    df = spark.createDataFrame(rows, "account int, code string, weight double, shares long, price double, value double, group string")
    got = {}
    for r in orders.repaired_groups(df, ["account"], [" BANK", "coal"], 0.5, 0.3).collect():
        got.setdefault(r.account, {})[r.code] = r
    moved = 0
    for a in range(12):
        own = [r for r in rows if r[0] == a]
        price = {r[1]: r[4] or 0.0 for r in own}
        w = {r[1]: r[2] for r in own}
        inside = {r[1] for r in own if r[6].lower() in ("bank", "coal")}
        shares = {r[1]: r[3] for r in own}
        budget = 60000 * sum(w.values())
        held = lambda s, price=price, inside=inside: sum(n * price[c] for c, n in s.items() if c in inside)
        off = lambda c, n, price=price, w=w: (n * price[c] / 60000 - w[c]) ** 2
        if held(shares) > budget / 2:
            while held(shares) > budget / 2 + 1e-8:
                choices = [((off(c, max(0, n - 100)) - off(c, n)) / (100 * price[c]), c) for c, n in shares.items() if c in inside and n > 0 and price[c]]
                if not choices:
                    break
                c = min(choices)[1]
                shares[c] -= 100
                moved += 1
            while True:
                left = budget - sum(n * price[c] for c, n in shares.items())
                choices = [(-(off(c, n) - off(c, n + 100)) / (100 * price[c]), c) for c, n in shares.items() if c not in inside and price[c] and 100 * price[c] <= left + 1e-8 and (n + 100) * price[c] / 60000 <= max(0.3, 1.35 * w[c]) + 1e-8 and off(c, n) - off(c, n + 100) > 1e-12]
                if not choices or left <= 0:
                    break
                shares[min(choices)[1]] += 100
        assert {c: r.shares for c, r in got[a].items()} == shares
        assert held(shares) <= budget / 2 + 1e-6
    assert moved > 10


def plain_guard(items, current, target, value):
    able = [i for i in items if i["actionable"] is not False]
    side = lambda s: [i for i in able if i["side"] == s]

    def order(i):
        rank = i["rank"] if i["rank"] is not None else None
        if i["side"] == "SELL":
            return i["mode"] != "REDUCE", i["transition"] != "EXIT", -rank if rank is not None else -np.inf, -i["gross"], i["id"]
        return i["mode"] != "INCREASE", rank if rank is not None else np.inf, -i["target_weight"], i["gross"], i["id"]

    def near(rows, budget):
        out, used = set(), 0.0
        for i in sorted(rows, key=order):
            if i["gross"] > 0 and abs(max(budget, 0) - used - i["gross"]) + 1e-8 < abs(max(budget, 0) - used):
                out.add(i["id"])
                used += i["gross"]
        return out, used

    buys, sells = side("BUY"), side("SELL")
    total = lambda rows: sum(i["gross"] for i in rows)
    every = lambda rows: ({i["id"] for i in rows}, total(rows))
    net = (target - current) * value
    if net > 0:
        s, got = near(sells, total(buys) - net)
        b = every(buys)[0] if current <= 0.01 else near(buys, net + got)[0]
    elif net < 0:
        b, got = near(buys, total(sells) + net)
        s = near(sells, got - net)[0]
    elif total(buys) <= total(sells):
        b = every(buys)[0]
        s = near(sells, total(buys))[0]
    else:
        s = every(sells)[0]
        b = near(buys, total(sells))[0]
    return b | s | {i["id"] for i in items if i["actionable"] is False}


def test_guard_against_a_plain_fold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for a in range(40):
        current, target = float(rng.choice([0.0, 0.5, 0.75])), float(rng.choice([0.0, 0.5, 0.75]))
        rows += [dict(account=a, id=i, side=str(rng.choice(["BUY", "SELL"])), gross=float(rng.integers(0, 60)) * 500, actionable=bool(rng.random() < 0.85), mode=str(rng.choice(["", "REDUCE", "INCREASE"])), transition=str(rng.choice(["EXIT", "ADJUST"])),
                      rank=None if rng.random() < 0.2 else int(rng.integers(1, 9)), target_weight=float(rng.integers(0, 4)) / 8, current=current, target=target, value=1e5) for i in range(rng.integers(1, 12))]
    df = spark.createDataFrame(rows, "account int, id int, side string, gross double, actionable boolean, mode string, transition string, rank int, target_weight double, current double, target double, value double")
    got = {}
    for r in orders.guarded(df, ["account"]).where("kept").collect():
        got.setdefault(r.account, set()).add(r.id)
    for a in range(40):
        own = [r for r in rows if r["account"] == a]
        assert got.get(a, set()) == plain_guard(own, own[0]["current"], own[0]["target"], 1e5), a
