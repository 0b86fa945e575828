"""python -m heddle SCHEMA [TABLE=FILE ...] [--sql FILE]: run a query file, or a shell without one."""

from __future__ import annotations

import argparse
import cmd

from heddle.plans.engine import Engine
from heddle.session import session


class Shell(cmd.Cmd):
    """create FILE | load TABLE FILE [TARGET] | list | delete TABLE | save FILE | restore FILE |
    translate QUERY (shows the plan) | execute QUERY | help | exit"""

    intro, prompt = "Tables by name; 'help' lists the commands.", "heddle> "

    def __init__(self, engine: Engine, **kw):
        super().__init__(**kw)
        self.engine = engine

    def _say(self, *what: object) -> None:
        print(*what, file=self.stdout)

    def do_create(self, path: str) -> None:
        """create FILE: take a schema file's tables."""
        self._say(*self.engine.declare(path))

    def do_load(self, words: str) -> None:
        """load TABLE FILE [TARGET]: delimited text; with TARGET, kept there as Parquet."""
        name, path, *target = words.split()
        self.engine.load(name, path, target=target[0] if target else None)

    def do_list(self, _: str) -> None:
        """list: the tables there are."""
        self._say(*self.engine.list())

    def do_delete(self, name: str) -> None:
        """delete TABLE: forget a table."""
        self.engine.delete(name)

    def do_save(self, path: str) -> None:
        """save FILE: keep the declarations."""
        self.engine.save(path)

    def do_restore(self, path: str) -> None:
        """restore FILE: take kept declarations back."""
        self._say(*self.engine.restore(path))

    def do_translate(self, query: str) -> None:
        """translate QUERY: show the plan."""
        self._say(self.engine.explain(query))

    def do_execute(self, query: str) -> None:
        """execute QUERY: show its first rows."""
        df = self.engine.sql(query)
        self._say("|".join(df.columns))
        for row in df.take(20):
            self._say("|".join("" if v is None else str(v) for v in row))

    def do_exit(self, _: str) -> bool:
        """exit: leave."""
        return True

    def onecmd(self, line: str) -> bool:
        try:
            return super().onecmd(line)
        except Exception as e:  # a wrong command leaves the shell open
            self._say(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            return False


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="heddle", description=__doc__)
    parser.add_argument("schema")
    parser.add_argument("tables", nargs="*", metavar="TABLE=FILE")
    parser.add_argument("--delimiter", default="|")
    parser.add_argument("--sql", metavar="FILE")
    parser.add_argument("--out", metavar="FOLDER", help="write the rows as Parquet instead of showing some")
    args = parser.parse_args(argv)
    engine = Engine(session())
    engine.declare(args.schema)
    for t in args.tables:
        name, _, path = t.partition("=")
        engine.load(name, path, args.delimiter)
    if not args.sql:
        Shell(engine).cmdloop()
    elif args.out:
        engine.sql_file(args.sql).write.mode("overwrite").parquet(args.out)
    else:
        engine.sql_file(args.sql).show(50, truncate=False)


if __name__ == "__main__":
    main()
