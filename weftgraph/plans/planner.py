"""Greedy order of a basic graph pattern's scans.

A variable's candidates are the fewest of: the distinct ends of each predicate it touches, the overlap of
each pair of them, and rows per constant where a constant is next to it.  The smallest scan comes first;
then always the connected scan that, by the statistics, matches the fewest rows for each row so far, then the
one whose new variables have the fewest candidates; scans that only close a cycle (bind nothing new) come
before all others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from weftgraph.plans.stats import Stats
from weftgraph.sparql.ast import Pattern

#: Without statistics: rows of a predicate, and the share that one constant end leaves.
ROWS = 1_000_000
SHARE = 0.001


def is_var(t: Any) -> bool:
    return isinstance(t, str) and t.startswith("?")


def candidates(patterns: list[Pattern], stats: Stats | None) -> dict[str, float]:
    touched: dict[str, list[tuple[str, str]]] = {}
    least: dict[str, float] = {}
    for p in patterns:
        for var, role, other in ((p.s, "s", p.o), (p.o, "o", p.s)):
            if not is_var(var):
                continue
            rows = stats.triples.get(p.p, 0) if stats and not is_var(p.p) else ROWS
            if not is_var(p.p):
                touched.setdefault(var, []).append((p.p, role))
            own = stats.ends.get((p.p, role), 0) if stats and not is_var(p.p) else ROWS
            if not is_var(other):
                far = stats.ends.get((p.p, "o" if role == "s" else "s"), 1) if stats and not is_var(p.p) else 1 / SHARE
                own = min(own, rows / max(far, 1))
            least[var] = min(least.get(var, float("inf")), own)
    if stats:
        for var, ends in touched.items():
            for i, (p, r) in enumerate(ends):
                for q, t in ends[i + 1 :]:
                    if (p, r) != (q, t):
                        least[var] = min(least[var], stats.common.get((p, r, q, t), 0))
    return least


@dataclass
class Scan:
    """One relation of the plan: its patterns, and the variables it binds."""

    patterns: list[Pattern]
    vars: frozenset[str] = field(default_factory=frozenset)

    def rows(self, stats: Stats | None) -> float:
        """Rows of the scan: the fewest of its patterns', divided among the values of a constant end."""
        found = []
        for p in self.patterns:
            if is_var(p.p):
                n = float(sum(stats.triples.values())) if stats else ROWS * 100
            else:
                n = stats.triples.get(p.p, 0) if stats else ROWS
            for t, role in ((p.s, "s"), (p.o, "o")):
                if not is_var(t):
                    n = n / max(1, stats.ends.get((p.p, role), 1)) if stats and not is_var(p.p) else n * SHARE
            found.append(n)
        return min(found)

    def matches(self, bound: set[str], stats: Stats | None) -> float:
        """Rows of the scan for each value of the variables that are bound already (0: not known)."""
        if stats is None:
            return 0.0
        n = self.rows(stats)
        for v in self.vars & bound:
            n /= max([1, *(_distinct(p, role, stats) for p in self.patterns for t, role in ((p.s, "s"), (p.p, "p"), (p.o, "o")) if t == v)])
        return n


def _distinct(p: Pattern, role: str, stats: Stats) -> int:
    if role == "p":
        return len(stats.triples)
    return sum(n for (q, r), n in stats.ends.items() if r == role and (is_var(p.p) or q == p.p))


def order(scans: list[Scan], stats: Stats | None = None) -> list[Scan]:
    least = candidates([p for s in scans for p in s.patterns], stats)
    rest, out, bound = list(scans), [], set()
    while rest:
        linked = [s for s in rest if s.vars & bound]
        if linked:
            fewest = lambda s: min((least.get(v, float("inf")) for v in s.vars - bound), default=0.0)
            best = min(linked, key=lambda s: (bool(s.vars - bound), s.matches(bound, stats), fewest(s), s.rows(stats)))
        else:
            best = min(rest, key=lambda s: s.rows(stats))
        rest.remove(best)
        out.append(best)
        bound |= best.vars
    return out
