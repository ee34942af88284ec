"""Command line: ``python -m marlstone.cli [--catalog FILE] VERB ..``: init, register, ddl, sql, explain, audit and shell. What queries did is appended to a file beside the catalog."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from marlstone import export
from marlstone.governance import TERMINAL
from marlstone.model import EngineError, MediaRef
from marlstone.session import MediaSession
from marlstone.sources.catalog import Catalog


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    top.add_argument("--catalog", default="marlstone-catalog.json")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init", help="make an empty catalog")
    own = verbs.add_parser("register", help="register media references under a name, in one change")
    own.add_argument("table")
    own.add_argument("media_type")
    own.add_argument("uri", nargs="+")
    verbs.add_parser("ddl", help="CREATE MEDIA TABLE, DROP TABLE, SHOW TABLES").add_argument("text")
    own = verbs.add_parser("sql", help="run a query over the catalog's tables")
    own.add_argument("text")
    own.add_argument("--format", choices=("json", "csv", "arrow"), default="json")
    own.add_argument("--seconds", type=float)
    verbs.add_parser("explain", help="the plan of a query").add_argument("text")
    own = verbs.add_parser("audit", help="what queries did, or one of them")
    own.add_argument("id", nargs="?")
    verbs.add_parser("shell", help="statements from the input, one a line; \\ddl TEXT, \\q")
    return top


def _spark() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Shell:
    def __init__(self, catalog: Catalog, out: TextIO, spark: SparkSession | None = None):
        self.catalog, self.out, self._spark, self._session = catalog, out, spark, None

    @property
    def session(self) -> MediaSession:
        if self._session is None:
            self._session = MediaSession(self._spark or _spark())
        self.catalog.register_in_session(self._session.spark)
        return self._session

    @property
    def audit_path(self) -> Path:
        return self.catalog.path.with_name(self.catalog.path.name + ".audit.jsonl")

    def ddl(self, text: str) -> None:
        found = self.catalog.execute(text)
        self.out.write("\n".join([found] if isinstance(found, str) else found) + "\n")

    def sql(self, text: str, form: str = "json", seconds: float | None = None) -> None:
        session = self.session
        query_id = session.create_query(text, seconds)
        own = session.queries.get(query_id)
        try:
            df = session.plan(text)
            if form == "arrow":
                export.write_arrow(df, self.out.buffer)
            else:
                for _ in session.queries.run(query_id, df.limit(0)):  # the query's permit, deadline and record
                    own.rows = (export.write_csv if form == "csv" else export.write_json)(df, self.out)
        finally:
            if own.status not in TERMINAL:
                session.queries._end(own, "failed" if sys.exc_info()[0] else "succeeded")
            with open(self.audit_path, "a") as f:
                f.write(json.dumps(own.audit()) + "\n")

    def run(self, given: TextIO) -> None:
        for line in given:
            line = line.strip()
            if line == "\\q":
                return
            try:
                if line.startswith("\\ddl "):
                    self.ddl(line[5:])
                elif line:
                    self.sql(line)
            except Exception as e:  # noqa: BLE001 a shell goes on after an error
                self.out.write(f"error: {e}\n")


def main(args: list[str] | None = None, out: TextIO = sys.stdout, given: TextIO = sys.stdin, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    shell = Shell(Catalog(a.catalog), out, spark)
    try:
        if a.verb == "init":
            shell.catalog._change(lambda tables: None)
        elif a.verb == "register":
            shell.catalog.register_media_table(a.table, [MediaRef(u, a.media_type) for u in a.uri], replace=True)
        elif a.verb == "ddl":
            shell.ddl(a.text)
        elif a.verb == "sql":
            shell.sql(a.text, a.format, a.seconds)
        elif a.verb == "explain":
            out.write(shell.session.explain(a.text) + "\n")
        elif a.verb == "audit":
            lines = shell.audit_path.read_text().splitlines() if shell.audit_path.exists() else []
            out.write("".join(x + "\n" for x in lines if a.id in (None, json.loads(x)["id"])))
        else:
            shell.run(given)
    except EngineError as e:
        out.write(f"error: {e.code}: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
