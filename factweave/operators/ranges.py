"""Conditions on one value: builders from nested lists, and canonical intervals for display."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..plans.ir import And, Cmp, Const, In, Or, Term


def condition(term: Term, spec: Any) -> Any:
    """A condition on term from a spec: ("<", 5, ">=", 1) joins its pairs by AND; lists nest, as in
    ["or", ["=", 1], ["and", [">", 5], ["<", 9]]]; ["in", 1, 2]; anything else is equality."""
    if isinstance(spec, list | tuple) and spec and isinstance(spec[0], str):
        head, rest = spec[0].lower(), spec[1:]
        if head in ("and", "or"):
            parts = [condition(term, s) for s in rest]
            return And(parts) if head == "and" else Or(parts)
        if head == "in":
            values = rest[0] if len(rest) == 1 and isinstance(rest[0], list | tuple) else rest
            return In(term, [Const(v) for v in values])
        if head in Cmp.OPS:
            pairs = [*zip(spec[::2], spec[1::2], strict=True)]
            parts = [Cmp(op, term, Const(v)) for op, v in pairs]
            return parts[0] if len(parts) == 1 else And(parts)
    if isinstance(spec, list | tuple):
        return And([condition(term, s) for s in spec])
    return Cmp("=", term, Const(spec))


@dataclass(frozen=True)
class Interval:
    """lo and hi, None being unbounded."""

    lo: Any = None
    hi: Any = None
    lo_in: bool = True
    hi_in: bool = True

    def __str__(self) -> str:
        if self.lo is not None and self.lo == self.hi:
            return f"{{{self.lo}}}"
        left = "(-inf" if self.lo is None else f"{'[' if self.lo_in else '('}{self.lo}"
        right = "+inf)" if self.hi is None else f"{self.hi}{']' if self.hi_in else ')'}"
        return f"{left}, {right}"

    def meet(self, other: Interval) -> Interval | None:
        lo, lo_in = max(((i.lo, not i.lo_in) for i in (self, other) if i.lo is not None), default=(None, False))
        hi, hi_in = min(((i.hi, i.hi_in) for i in (self, other) if i.hi is not None), default=(None, True))
        lo_in = not lo_in
        if lo is not None and hi is not None and (lo > hi or lo == hi and not (lo_in and hi_in)):
            return None
        return Interval(lo, hi, lo_in, hi_in)


EVERYTHING = [Interval()]


def union(intervals: list[Interval]) -> list[Interval]:
    """Sorted, disjoint intervals of the same values; touching ones are joined."""
    out: list[Interval] = []
    for i in sorted(intervals, key=lambda i: (i.lo is not None, i.lo if i.lo is not None else 0, not i.lo_in)):
        last = out[-1] if out else None
        if last and (last.hi is None or i.lo is None or i.lo < last.hi or i.lo == last.hi and (i.lo_in or last.hi_in)):
            if last.hi is not None and (i.hi is None or (i.hi, i.hi_in) > (last.hi, last.hi_in)):
                out[-1] = Interval(last.lo, i.hi, last.lo_in, i.hi_in)
        else:
            out.append(i)
    return out


def intervals(node: Any) -> list[Interval]:
    """The values that a condition on one value with constants allows; none if it contradicts itself."""
    if isinstance(node, And):
        out = EVERYTHING
        for part in node.parts:
            out = union([m for a in out for b in intervals(part) if (m := a.meet(b))])
        return out
    if isinstance(node, Or):
        return union([i for part in node.parts for i in intervals(part)])
    if isinstance(node, In) and node.negated:
        return intervals(And([Cmp("!=", node.term, c) for c in node.values]))
    if isinstance(node, In):
        return union([Interval(c.value, c.value) for c in node.values])
    v = node.right.value
    return {
        "=": [Interval(v, v)], "!=": [Interval(None, v, hi_in=False), Interval(v, None, lo_in=False)],
        "<": [Interval(None, v, hi_in=False)], "<=": [Interval(None, v)], ">": [Interval(v, None, lo_in=False)], ">=": [Interval(v, None)],
    }[node.op]


def show(node: Any) -> str:
    return " U ".join(map(str, intervals(node))) or "empty"
