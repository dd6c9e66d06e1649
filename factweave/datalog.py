"""The datalog API: prepare(find, where, ranges, given)."""

from __future__ import annotations

import contextlib
import io
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame

from .operators.ranges import condition
from .plans.ir import And, Const, Pattern, Query, Slot, Var, conjuncts, substituted
from .sources.catalog import SchemaError


class Prepared:
    """A query that keeps names, resolved anew each time it runs. Results are sets."""

    def __init__(self, session: Any, find: list[str], where: list[tuple], ranges: dict[str, Any], given: dict[str, Any]):
        self.session, self.find = session, [f for f in find if f not in given]
        patterns = [self.pattern(c) for c in where]
        names = {v for p in patterns for v in p.variables()}
        for f in find:
            if f not in names:
                raise ValueError(f"{f} isn't in any clause")
        for f in sorted(names - set(find) - set(given)):
            raise ValueError(f"{f} isn't in find")
        for f in [*ranges, *given]:
            if f not in names:
                raise ValueError(f"{f} isn't in any clause")
        for p in patterns:
            if max(Counter(p.variables()).values(), default=0) > 2:
                raise ValueError("a variable may stand twice in a clause at most")
        constants = {k: Const(v) for k, v in given.items()}
        self.patterns = [substituted(p, constants) for p in patterns]
        conditions = [c for k, spec in ranges.items() for c in conjuncts(condition(Var(k), spec))]
        self.condition = substituted(And(conditions), constants) if conditions else None

    def pattern(self, clause: tuple) -> Pattern:
        if not 3 <= len(clause) <= 5:
            raise ValueError(f"a clause has 3 to 5 slots: {clause!r}")
        slots: list[Slot] = [None if s == "_" else Var(s) if isinstance(s, str) and s.startswith("?") else Const(s) for s in clause]
        if isinstance(slots[1], Const):
            if isinstance(slots[1].value, int) and slots[1].value in self.session.catalog.by_id:
                slots[1] = Const(self.session.catalog.by_id[slots[1].value].name)
            slots[1] = Const(self.session.catalog.get(str(slots[1].value)).name)
        return Pattern(*slots)

    def query(self) -> Query:
        # a wildcard or a missing variable leaves duplicates; facts themselves are unique
        dropped = any(p.v is None or p.e is None or p.a is None for p in self.patterns)
        find = [(f.lstrip("?"), Var(f)) for f in self.find]
        return Query(find, self.patterns, self.condition, exists=not find, distinct=dropped and bool(find))

    def df(self) -> DataFrame:
        return self.session.compiler(self.query()).result()

    execute = df

    def ordered(self) -> DataFrame:
        df = self.df()
        return df.orderBy(*df.columns)

    def first(self) -> tuple | None:
        rows = self.collect(1)
        return rows[0] if rows else None

    def collect(self, limit: int | None = None) -> list[tuple]:
        """Rows in the order of find, ascending; with a limit only the first are sorted out."""
        df = self.ordered()
        return [tuple(r) for r in (df if limit is None else df.limit(limit)).collect()]

    def explain(self) -> str:
        compiler = self.session.compiler(self.query())
        df = compiler.result()
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain("formatted")
        return "\n".join([*map(str, self.patterns), *compiler.plan, text.getvalue()])


def prepare(session: Any, find: list[str], where: list[tuple], ranges: dict | None = None, given: dict | None = None) -> Prepared:
    return Prepared(session, find, where, ranges or {}, given or {})


__all__ = ["Prepared", "SchemaError", "prepare"]
