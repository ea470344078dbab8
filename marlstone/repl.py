"""A line REPL: statements end with a semicolon, dot-commands stand alone."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException

from .errors import SqlError
from .golden import cell
from .session import Session

HELP = ".help   this text\n.tables names of the tables\n.quit   leave (also .exit)"


def answer(session: Session, text: str) -> str:
    try:
        result = session.sql(text)
        return result.tag or "\n".join(" ".join(map(cell, row)) for row in result.rows())
    except SqlError as error:
        return f"error: {error}"
    except PySparkException as error:  # what the engine has no name for; the next statement may work
        return f"error: {str(error).strip().splitlines()[0]}"


def loop(session: Session, lines=sys.stdin, out=sys.stdout) -> None:
    held = ""
    for line in lines:
        word = line.strip()
        if not held and word.strip("; ") == "":  # blank lines and lone semicolons between statements
            continue
        if not held and word.startswith("."):
            if word in (".quit", ".exit"):
                return
            print({".help": HELP, ".tables": "\n".join(session.catalog.tables)}.get(word, f"unknown command {word}"), file=out)
            continue
        held += line
        if held.rstrip().endswith(";"):
            print(answer(session, held), file=out)
            held = ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    loop(Session(SparkSession.builder.appName("marlstone").getOrCreate()))
