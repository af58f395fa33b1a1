"""Strategy settings: JSON files that extend one another, weight maps and routing by capital."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Strategy:
    """What a run can be told; unknown names are refused."""

    name: str = "default"
    initial_cash: float = 100_000.0
    rebalance_every: int = 20
    least_days: int = 252
    least_amount: float = 1e7
    count: int = 20
    buy_rank: int = 20
    sell_rank: int = 40
    stock_cap: float = 0.10
    group_cap: float = 0.30
    equity: float = 0.95
    target_volatility: float = 0.18
    commission: float = 0.0
    min_commission: float = 0.0
    slippage_bps: float = 0.0
    participation: float = 0.05
    min_trade_value: float = 0.0


def load(path: str | Path, seen: tuple[Path, ...] = ()) -> Strategy:
    """A strategy from JSON; ``extends`` names a file, relative to this one, whose settings it starts from."""
    at = Path(path).resolve()
    if at in seen:
        raise ValueError(f"{at} extends itself")
    own = json.loads(at.read_text())
    base = load(at.parent / own.pop("extends"), (*seen, at)) if "extends" in own else Strategy()
    unknown = set(own) - {f.name for f in fields(Strategy)}
    if unknown:
        raise ValueError(f"unknown settings in {at}: {sorted(unknown)}")
    return replace(base, **own)


def dump(strategy: Strategy) -> str:
    return json.dumps(asdict(strategy), sort_keys=True)


def weight_map(given: dict[str, float], known: list[str]) -> dict[str, float]:
    """Non-negative weights of known components that sum to 1; equal where none is positive."""
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown components: {sorted(unknown)}")
    w = {k: max(0.0, float(given.get(k, 0.0))) for k in known}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else {k: 1 / len(known) for k in known}


def route(capital: float, tiers: list[tuple[float, float | None, str]]) -> str:
    """Name of the tier [low, high) that holds the capital; tiers must follow on one another."""
    ordered = sorted(tiers)
    for (_, high, _), (low, _, _) in zip(ordered, ordered[1:]):
        if high != low:
            raise ValueError(f"tiers leave a gap or overlap at {low}")
    for low, high, name in ordered:
        if capital >= low and (high is None or capital < high):
            return name
    raise ValueError(f"no tier for {capital}")


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def stage_hashes(settings: dict, stages: dict[str, list[str] | None], version: str, rolling: tuple[str, ...] = ("model_end_date",)) -> dict[str, str]:
    """A hash for each stage of a build, in order: of the settings that it names (None: all), the version of the algorithm, and the stage before it.

    ``rolling`` settings only say how far a build goes and are part of no hash, so that a longer horizon goes on with what is there.
    """
    out, before = {}, ""
    fixed = {k: v for k, v in settings.items() if k not in rolling}
    for stage, names in stages.items():
        own = fixed if names is None else {k: fixed.get(k) for k in names if k not in rolling}
        before = out[stage] = hashlib.sha256(_canonical({"version": version, "before": before, "settings": own}).encode()).hexdigest()
    return out


def extends_horizon(previous: dict, now: dict, rolling: str = "model_end_date") -> bool:
    """Whether the settings of a build differ from earlier ones in a later end alone: what was built under the earlier ones then counts."""
    rest = lambda d: {k: v for k, v in d.items() if k != rolling}
    return _canonical(rest(previous)) == _canonical(rest(now)) and str(now.get(rolling, "")) >= str(previous.get(rolling, ""))
