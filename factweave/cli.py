"""A small shell: statements end with ;  -e STATEMENT runs one. Rows come as tab-separated text.

.schema  .dump [INDEX]  .status  .tree  .flush  .compact PATH  .help  .quit
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import Any, TextIO

from . import admin


def shown(value: Any) -> str:
    return "" if value is None else str(value).replace("\t", " ").replace("\n", " ")


class Shell:
    def __init__(self, session: Any, out: TextIO = sys.stdout):
        self.session, self.out = session, out

    def say(self, rows: Iterable, columns: Iterable[str] = ()) -> None:
        if columns:
            print("\t".join(columns), file=self.out)
        for r in rows:
            print("\t".join(map(shown, r)), file=self.out)

    def run(self, statement: str) -> None:
        try:
            found = self.session.sql(statement)
            self.say(found, found.columns)
        except (ValueError, TypeError) as e:
            print(f"error: {e}", file=self.out)

    def command(self, line: str) -> bool:
        """Run a dot command; False to stop."""
        name, *args = line.split()
        if name in (".quit", ".exit"):
            return False
        if name in (".schema", ".dump", ".tree"):
            df = {".schema": self.session.schema, ".dump": lambda: self.session.dump(*args[:1]), ".tree": lambda: admin.tree(self.session)}[name]()
            self.say(df.toLocalIterator(), df.columns)
        elif name == ".status":
            self.say(admin.status(self.session).items())
        elif name == ".flush":
            self.say([[admin.flush(self.session)]])
        elif name == ".compact":
            self.say([[admin.compact(self.session)]])
        elif name in (".gc", ".gc-dry"):
            self.say([s] for s in admin.gc(self.session, dry=name == ".gc-dry"))
        else:
            print(__doc__, file=self.out)
        return True

    def loop(self, lines: Iterable[str]) -> None:
        held = ""
        for line in lines:
            if not held and line.startswith("."):
                if not self.command(line):
                    return
                continue
            held += line
            if held.rstrip().endswith(";"):
                self.run(held)
                held = ""


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    from .session import Session

    path = args[args.index("--path") + 1] if "--path" in args else None
    shell = Shell(Session(SparkSession.builder.getOrCreate(), path))
    if "-e" in args:
        shell.run(args[args.index("-e") + 1])
    else:
        shell.loop(sys.stdin)
    shell.session.commit()


if __name__ == "__main__":
    main(sys.argv[1:])
