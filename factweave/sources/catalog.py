"""The attribute catalog: small, on the driver, and stored as facts of the db attributes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.ids import FIRST_CUSTOM, FIRST_DB_SEQ
from ..functions.values import ValueType

# fixed values: the built-in idents and their ids
BOOTSTRAP = {
    "db.ident": 1, "db.cardinality": 2, "db.valueType": 3, "db.isComponent": 4, "db.unique": 5, "db.index": 6, "db.fulltext": 7, "db.noHistory": 8, "db.txInstant": 9,
    "db.type.string": 20, "db.type.ref": 21, "db.type.long": 22, "db.type.keyword": 23, "db.type.boolean": 24, "db.type.instant": 25, "db.type.bytes": 26, "db.type.float": 27, "db.type.blob": 28,
    "db.cardinality.one": 35, "db.cardinality.many": 36, "db.unique.value": 37, "db.unique.identity": 38, "db.part/id": 39, "db.part/db": 40, "db.part/tx": 41, "db.part/user": 42,
}
ONE, MANY, UNIQUE = 35, 36, 38
BUILT_IN = {
    "db.ident": ValueType.STRING, "db.cardinality": ValueType.REF, "db.valueType": ValueType.REF, "db.isComponent": ValueType.BOOLEAN, "db.unique": ValueType.REF,
    "db.index": ValueType.BOOLEAN, "db.fulltext": ValueType.BOOLEAN, "db.noHistory": ValueType.BOOLEAN, "db.txInstant": ValueType.INSTANT,
}


class SchemaError(ValueError):
    pass


def normalized(name: str) -> str:
    """`:ns/attr` is `ns.attr`; a name needs its namespace."""
    if name.startswith(":") and "/" in name:
        name = name[1:].replace("/", ".")
    if "." not in name.strip("."):
        raise SchemaError(f"attribute {name!r} has no namespace")
    return name


@dataclass
class Attribute:
    aid: int
    name: str
    type: ValueType
    many: bool = False
    unique: bool = False
    indexed: bool = False
    source: Any = None  # a RelationalSource, or None for the log
    retracted: bool = False  # whether a fact was ever retracted


@dataclass
class Catalog:
    attributes: dict[str, Attribute] = field(default_factory=dict)
    by_id: dict[int, Attribute] = field(default_factory=dict)
    partitions: dict[str, int] = field(default_factory=lambda: {"db": 0, "tx": 3, "user": 4})
    next_aid: int = FIRST_DB_SEQ

    def __post_init__(self) -> None:
        for name, kind in BUILT_IN.items():
            self.put(Attribute(BOOTSTRAP[name], name, kind, unique=name == "db.ident"))

    def put(self, a: Attribute) -> Attribute:
        self.attributes[a.name] = self.by_id[a.aid] = a
        return a

    def get(self, name: str) -> Attribute:
        try:
            return self.attributes[normalized(name)]
        except KeyError:
            raise SchemaError(f"unknown attribute {name!r}") from None

    def declare(self, name: str, kind: ValueType, many: bool = False, unique: bool = False, indexed: bool = False, source: Any = None) -> tuple[Attribute, bool]:
        """The attribute, and whether anything changed. Declared again: the same is a no-op, another
        cardinality is taken over, another type is an error."""
        name = normalized(name)
        old = self.attributes.get(name)
        if old is None:
            self.next_aid += 1
            return self.put(Attribute(self.next_aid - 1, name, kind, many, unique, indexed or unique, source)), True
        if old.type != kind:
            raise SchemaError(f"{name} is {old.type.name}, not {kind.name}")
        changed = old.many != many or unique and not old.unique
        old.many, old.unique = many, old.unique or unique
        return old, changed

    def partition(self, name: str) -> int:
        if name not in self.partitions:
            self.partitions[name] = max(FIRST_CUSTOM - 1, *self.partitions.values()) + 1
        return self.partitions[name]

    def rows(self) -> list[tuple[int, str, str, str, bool, bool]]:
        return [(a.aid, a.name, a.type.name, "MANY" if a.many else "ONE", a.unique, a.indexed) for a in sorted(self.by_id.values(), key=lambda a: a.aid)]
