"""A catalog of media tables in one JSON file, and the small language that changes it."""

from __future__ import annotations

import json
import re
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from marlstone.model import MEDIA, EngineError, Lineage, MediaRef, refuse_credentials
from marlstone.sources.files import locked, replace_json

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DDL = re.compile(r"\s*(?:(CREATE\s+MEDIA\s+TABLE)\s+(\S+)|(DROP\s+TABLE)\s+(\S+)|(SHOW\s+TABLES))\s*;?\s*", re.I)
FORMAT = 1


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise EngineError("identifier", f"a name is a letter or underscore, then letters, digits and underscores: {name!r}")
    return name


class Catalog:
    """Tables of media references with an optional lineage. Every change is one replacement of the file under an exclusive lock, made on the file as it is then."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _load(self) -> dict:
        if not self.path.exists():
            return {}
        try:
            found = json.loads(self.path.read_text())
            if found["format_version"] != FORMAT:
                raise EngineError("catalog_format", f"format {found['format_version']} isn't supported")
            return found["tables"]
        except (ValueError, KeyError, TypeError) as e:
            raise EngineError("catalog_format", f"the catalog can't be read: {e}") from e

    def _change(self, change) -> None:
        with locked(self.path.with_name(self.path.name + ".lock"), True, "catalog_busy"):
            tables = self._load()
            change(tables)
            replace_json(self.path, {"format_version": FORMAT, "tables": tables})

    def tables(self) -> list[str]:
        return sorted(self._load())

    def register_media_table(self, name: str, media: list[MediaRef], lineage: Lineage | None = None, replace: bool = False, metadata: dict[str, str] | None = None) -> None:
        """Add a table; with ``replace`` also in the place of one, in one change."""
        check_identifier(name)
        entry = {"media": [asdict(m) for m in media], "lineage": lineage.plain() if lineage else None, "metadata": metadata or {}}
        entry = json.loads(json.dumps(entry, default=str))
        refuse_credentials(entry)

        def change(tables: dict) -> None:
            if name in tables and not replace:
                raise EngineError("table_exists", f"there is a table {name}")
            tables[name] = entry

        self._change(change)

    def drop_table(self, name: str) -> None:
        def change(tables: dict) -> None:
            if tables.pop(check_identifier(name), None) is None:
                raise EngineError("table_missing", f"there is no table {name}")

        self._change(change)

    def media_table(self, name: str) -> list[MediaRef]:
        return [MediaRef(**m) for m in self._entry(name)["media"]]

    def lineage(self, name: str) -> Lineage | None:
        own = self._entry(name)["lineage"]
        return Lineage(**own) if own else None

    def metadata(self, name: str) -> dict[str, str]:
        return self._entry(name)["metadata"]

    def _entry(self, name: str) -> dict:
        own = self._load().get(check_identifier(name))
        if own is None:
            raise EngineError("table_missing", f"there is no table {name}")
        return own

    def register_in_session(self, spark: SparkSession) -> list[str]:
        """A view for each table, with one column ``media``."""
        for name in (names := self.tables()):
            spark.createDataFrame([(m.row(),) for m in self.media_table(name)], f"media {MEDIA}").createOrReplaceTempView(name)
        return names

    def execute(self, text: str) -> list[str] | str:
        """``CREATE MEDIA TABLE n``, ``DROP TABLE n`` (both give the name) or ``SHOW TABLES``, keywords in any case."""
        m = _DDL.fullmatch(text)
        if not m:
            raise EngineError("ddl", "CREATE MEDIA TABLE name, DROP TABLE name or SHOW TABLES")
        if m[5]:
            return self.tables()
        name = check_identifier((m[2] or m[4]).rstrip(";"))
        if m[1]:
            self.register_media_table(name, [])
        else:
            self.drop_table(name)
        return name
