"""Ordered rule lists by incremental reduced-error pruning, and their export to SQL.

A rule is grown on two thirds of the remaining rows, condition by condition, by the gain of information, then pruned on the
other third; rows it covers are set aside and the next rule is grown, until a rule is no better than chance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

#: A condition is (statistic, "<=" or ">=", threshold); a rule is (kind, conditions).
Condition = tuple[str, str, float]
Rule = tuple[str, tuple[Condition, ...]]
#: Thresholds tried for each statistic while a rule grows.
CUTS = 64


def covers(conditions: Sequence[Condition], data: Mapping[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(data.values()))), bool)
    for name, op, cut in conditions:
        out &= data[name] <= cut if op == "<=" else data[name] >= cut
    return out


def _grow(data: Mapping[str, np.ndarray], positive: np.ndarray) -> list[Condition]:
    held, rule = np.ones(len(positive), bool), []
    while (held & ~positive).any():
        p0, n0 = (held & positive).sum(), (held & ~positive).sum()
        best: tuple[float, Condition | None] = (0.0, None)
        for name, column in data.items():
            values = np.unique(column[held])
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > CUTS:
                middles = middles[np.linspace(0, len(middles) - 1, CUTS).astype(int)]
            for cut in middles:
                low = held & (column <= cut)
                for op, side in (("<=", low), (">=", held & ~low)):
                    p, n = (side & positive).sum(), (side & ~positive).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, op, float(f"{cut:.6g}")))
        if best[1] is None:
            break
        rule.append(best[1])
        held = covers(rule, data)
    return rule


def _worth(conditions: Sequence[Condition], data: Mapping[str, np.ndarray], positive: np.ndarray) -> float:
    held = covers(conditions, data)
    p, n = int((held & positive).sum()), int((held & ~positive).sum())
    return (p - n) / (p + n) if p + n else -1.0


def induce(data: Mapping[str, np.ndarray], kinds: np.ndarray, order: Sequence[str], seed: int = 0) -> list[Rule]:
    """Rules for each kind in order; rows that no rule covers are of the remaining kind."""
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(kinds), bool)
    for kind in order:
        while (left & (kinds == kind)).any():
            rows = rng.permutation(np.flatnonzero(left))
            # both parts keep the share of the kind
            rows = np.r_[rows[kinds[rows] == kind], rows[kinds[rows] != kind]]
            to_prune = np.arange(len(rows)) % 3 == 2
            grow, prune = rows[~to_prune], rows[to_prune]
            part = lambda ids: {c: v[ids] for c, v in data.items()}
            rule = _grow(part(grow), kinds[grow] == kind)
            if not rule:
                break
            kept = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, part(prune), kinds[prune] == kind))
            if _worth(kept, part(prune), kinds[prune] == kind) <= 0.0:
                break
            rules.append((kind, tuple(kept)))
            left &= ~covers(kept, data)
    return rules


def classify(rules: Sequence[Rule], data: Mapping[str, np.ndarray], default: str) -> np.ndarray:
    out = np.full(len(next(iter(data.values()))), default, dtype=object)
    for kind, conditions in reversed(rules):
        out[covers(conditions, data)] = kind
    return out


def case_expression(rules: Sequence[Rule], valid: str, default: str) -> str:
    """A SQL CASE that gives the kind of the first rule that covers a row, default if none does, null if not valid."""
    lines = [f"WHEN NOT ({valid}) THEN NULL"]
    for kind, conditions in rules:
        lines.append("WHEN " + " AND ".join(f"{c} {op} {cut!r}D" for c, op, cut in conditions) + f" THEN '{kind}'")
    return "CASE " + " ".join(lines) + f" ELSE '{default}' END"


try:
    from .learned import RULES
except ImportError:  # before the first training
    RULES = ()
