"""Interactive shell: statements end with ``;``, ``.quit`` or ``.exit`` leaves."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Iterator
from typing import TextIO

from pyspark.errors import PySparkException

from grainmill.plans.database import Database, Result


def grid(result: Result) -> Iterator[str]:
    """Lines of a result as a grid with its number of rows; a message as it is.

    All rows come, as a stream: they are read once for the widths and once more for the lines.
    """
    if result.message:
        yield result.message
        return
    n, widths = 0, list(map(len, result.columns))
    for row in result.rows():
        n += 1
        widths = [max(w, len(cell)) for w, cell in zip(widths, row, strict=True)]
    if n:
        def line(cells: list[str]) -> str:
            return "| " + " | ".join(cell.ljust(w) for cell, w in zip(cells, widths, strict=True)) + " |"

        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        yield from (rule, line(result.columns), rule)
        yield from map(line, result.rows())
        yield rule
    yield f"({n} row{'' if n == 1 else 's'})"


def complete(text: str) -> bool:
    """Whether a statement ends here: with ``;``, outside texts and comments."""
    bare = re.sub(r"'[^']*'|--[^\n]*", "", text)
    return "'" not in bare and bare.rstrip().endswith(";")


def run(database: Database, read: TextIO = sys.stdin, write: TextIO = sys.stdout) -> None:
    """Read statements until the end; errors are printed and the shell goes on."""
    held: list[str] = []
    while True:
        write.write("   ...> " if held else "grain> ")
        write.flush()
        line = read.readline()
        if not line or (not held and line.strip() in (".quit", ".exit")):
            break
        if not held and not line.strip():
            continue
        held.append(line.rstrip("\n"))
        if not complete("\n".join(held)):
            continue
        sql, held = "\n".join(held), []
        began = time.time()
        try:
            for text in grid(database.execute(sql)):
                write.write(f"{text}\n")
            write.write(f"{time.time() - began:.2f} s\n")
        except (ValueError, TypeError, PySparkException) as e:
            write.write(f"Error: {str(e).splitlines()[0]}\n")


if __name__ == "__main__":
    from grainmill.session import session

    run(Database(session(), compat="--compat" in sys.argv))
