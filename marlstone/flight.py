"""A loopback Arrow Flight server of a session's queries, and its client.

A statement is planned once and becomes a ticket that can be redeemed once; tickets that aren't redeemed lapse. Only reading statements are taken.
"""

from __future__ import annotations

import ipaddress
import json
import secrets
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.flight as fl
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.model import EngineError
from marlstone.session import MediaSession, is_reading

MOST_TICKETS, TICKET_SECONDS = 1_024, 300.0


def is_loopback(host: str) -> bool:
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host.strip("[]")).is_loopback
    except ValueError:
        return False


@dataclass
class _Planned:
    df: DataFrame
    query_id: str
    until: float


class _Bearer(fl.ServerMiddlewareFactory):
    def __init__(self, token: str):
        self.token = token

    def start_call(self, info, headers):
        given = next((v[0] for k, v in headers.items() if k.lower() == "authorization"), "")
        if not secrets.compare_digest(given, f"Bearer {self.token}"):
            raise fl.FlightUnauthenticatedError("a bearer token is due")


class Server(fl.FlightServerBase):
    """``get_flight_info`` of a command that is a statement, ``do_get`` of its ticket, ``list_flights`` of tables, and the actions ``cancel`` (a query's id), ``prepare`` and ``close``."""

    def __init__(self, session: MediaSession, host: str = "127.0.0.1", port: int = 0, token: str | None = None):
        if not is_loopback(host):
            raise EngineError("flight_address", "the server listens on a loopback address only")
        super().__init__(f"grpc://{host}:{port}", middleware={"bearer": _Bearer(token)} if token else {})
        self.session, self._planned, self._prepared, self._lock = session, {}, {}, threading.Lock()

    def _plan(self, text: str) -> _Planned:
        if not is_reading(text):
            raise fl.FlightServerError("only reading statements are served")
        try:
            return _Planned(self.session.plan(text), self.session.create_query(text), time.monotonic() + TICKET_SECONDS)
        except Exception as e:  # noqa: BLE001 the plan's error is the caller's
            raise fl.FlightServerError(f"the statement can't be planned: {e}") from e

    def _keep(self, own: _Planned, where: dict) -> str:
        now = time.monotonic()
        with self._lock:
            for d in (self._planned, self._prepared):
                for k in [k for k, p in d.items() if p.until < now]:
                    del d[k]
            if len(self._planned) + len(self._prepared) >= MOST_TICKETS:
                raise fl.FlightServerError("too many statements wait")
            where[key := secrets.token_hex(16)] = own
        return key

    def get_flight_info(self, context, descriptor):
        command = descriptor.command.decode()
        own = self._prepared.get(command.removeprefix("prepared:")) if command.startswith("prepared:") else self._plan(command)
        if own is None:
            raise fl.FlightServerError("no such prepared statement")
        if command.startswith("prepared:"):
            own = _Planned(own.df, self.session.create_query(self.session.queries.get(own.query_id).text), time.monotonic() + TICKET_SECONDS)
        ticket = json.dumps({"ticket": self._keep(own, self._planned), "query": own.query_id}).encode()
        return fl.FlightInfo(to_arrow_schema(own.df.schema), descriptor, [fl.FlightEndpoint(ticket, [])], -1, -1)

    def do_get(self, context, ticket):
        with self._lock:
            own = self._planned.pop(json.loads(ticket.ticket)["ticket"], None)
        if own is None:
            raise fl.FlightServerError("the ticket was redeemed or has lapsed")
        schema = to_arrow_schema(own.df.schema)
        return fl.GeneratorStream(schema, self.session.queries.run(own.query_id, own.df))

    def list_flights(self, context, criteria):
        for catalog, schema, table in self.session.catalog_tables():
            name = ".".join(x for x in (catalog, schema, table) if x)
            yield fl.FlightInfo(pa.schema([]), fl.FlightDescriptor.for_path(name), [], -1, -1)

    def list_actions(self, context):
        return [("cancel", "Cancel the query with this id."), ("prepare", "Plan a statement; gives a handle."), ("close", "Forget a prepared statement."), ("info", "What the server offers.")]

    def do_action(self, context, action):
        body = action.body.to_pybytes().decode()
        if action.type == "cancel":
            found = {"cancelled": self.session.cancel_query(body)}
        elif action.type == "prepare":
            found = {"handle": self._keep(self._plan(body), self._prepared)}
        elif action.type == "close":
            found = {"closed": self._prepared.pop(body, None) is not None}
        elif action.type == "info":
            found = {"read_only": True, "transactions": False, "functions": ["document_sections", "document_tables", "document_images", "document_search", "document_ocr", "video_frames", "audio_segments", "transcript_search", "semantic_search", "hybrid_search"]}
        else:
            raise fl.FlightServerError(f"no action {action.type}")
        yield fl.Result(json.dumps(found).encode())


class Client:
    """``token`` is asked for before each call. Without TLS only loopback addresses are called."""

    def __init__(self, address: str, token: Callable[[], str] | None = None):
        host = address.partition("://")[2].rpartition(":")[0]
        if not address.startswith("grpc+tls://") and not is_loopback(host):
            raise EngineError("flight_address", "other hosts are called with TLS only")
        self._client, self._token = fl.FlightClient(address), token

    def _options(self) -> fl.FlightCallOptions:
        return fl.FlightCallOptions(headers=[(b"authorization", f"Bearer {self._token()}".encode())] if self._token else [])

    def info(self, text: str) -> fl.FlightInfo:
        return self._client.get_flight_info(fl.FlightDescriptor.for_command(text.encode()), self._options())

    def fetch(self, info: fl.FlightInfo) -> pa.Table:
        return self._client.do_get(info.endpoints[0].ticket, self._options()).read_all()

    def query(self, text: str) -> pa.Table:
        return self.fetch(self.info(text))

    def action(self, kind: str, body: str = "") -> dict:
        return json.loads(next(iter(self._client.do_action(fl.Action(kind, body.encode()), self._options()))).body.to_pybytes())

    def tables(self) -> list[str]:
        return [b".".join(f.descriptor.path).decode() for f in self._client.list_flights(options=self._options())]

    def close(self) -> None:
        self._client.close()
