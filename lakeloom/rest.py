"""A small HTTP service over a catalog, from the standard library: ``serve(catalog, port)``.

GET /health, GET /v1/config[?warehouse=w], GET and POST /v1/namespaces,
GET and POST /v1/namespaces/{ns}/tables, GET and DELETE
/v1/namespaces/{ns}/tables/{table}.  With a secret, a request needs a bearer
token signed with HMAC-SHA256 (a JWT with an optional ``exp``).
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from .errors import CatalogError, LakeloomError, NamespaceAlreadyExists, TableNotFound
from .plans.schema import Schema
from .sources.catalog import Catalog


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def sign(claims: dict, secret: str) -> str:
    """A token for these claims."""
    body = f"{_b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{_b64(json.dumps(claims).encode())}"
    return f"{body}.{_b64(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())}"


def verify(token: str, secret: str) -> bool:
    """Whether a token carries our signature and has not run out."""
    body, _, signature = token.rpartition(".")
    if not hmac.compare_digest(signature, _b64(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())):
        return False
    try:
        payload = body.split(".")[1]
        claims = json.loads(base64.urlsafe_b64decode(payload + "=" * (-len(payload) % 4)))
    except (IndexError, ValueError):
        return False
    return claims.get("exp", float("inf")) > time.time()


class _Handler(BaseHTTPRequestHandler):
    catalog: Catalog
    secret: str | None = None

    def log_message(self, *args) -> None:
        pass

    def _answer(self, status: int, body: dict | None = None) -> None:
        data = json.dumps(body).encode() if body is not None else b""
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _body(self) -> dict:
        return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")

    def _route(self, method: str) -> None:
        url = urlparse(self.path)
        parts = [unquote(p) for p in url.path.strip("/").split("/")]
        if self.secret and parts != ["health"] and not verify((self.headers.get("Authorization") or "").removeprefix("Bearer "), self.secret):
            return self._answer(401, {"error": "a valid token is needed"})
        c = self.catalog
        try:
            match (method, *parts):
                case ("GET", "health"):
                    self._answer(200, {"status": "ok"})
                case ("GET", "v1", "config"):
                    asked = parse_qs(url.query).get("warehouse")
                    self._answer(200, {"defaults": {}, "overrides": {"warehouse": asked[0] if asked else c.warehouse}})
                case ("GET", "v1", "namespaces"):
                    self._answer(200, {"namespaces": [list(n) for n in c.list_namespaces()]})
                case ("POST", "v1", "namespaces"):
                    body = self._body()
                    c.create_namespace(tuple(body["namespace"]), body.get("properties"))
                    self._answer(200, {"namespace": body["namespace"], "properties": body.get("properties", {})})
                case ("GET", "v1", "namespaces", ns, "tables"):
                    self._answer(200, {"identifiers": [{"namespace": list(t.namespace), "name": t.name} for t in c.list_tables(ns)]})
                case ("POST", "v1", "namespaces", ns, "tables"):
                    body = self._body()
                    schema = Schema.from_json({"schema-id": 0} | body["schema"])
                    table = c.create_table(f"{ns}.{body['name']}", schema, properties=body.get("properties"))
                    self._answer(201, {"metadata": table.metadata.to_json()})
                case ("GET", "v1", "namespaces", ns, "tables", name):
                    self._answer(200, {"metadata": c.load_table(f"{ns}.{name}").metadata.to_json()})
                case ("DELETE", "v1", "namespaces", ns, "tables", name):
                    c.drop_table(f"{ns}.{name}", purge="true" in parse_qs(url.query).get("purge", []))
                    self._answer(204)
                case _:
                    self._answer(404, {"error": f"no such path: {self.path}"})
        except TableNotFound as e:
            self._answer(404, {"error": f"no such table: {e}"})
        except NamespaceAlreadyExists as e:
            self._answer(409, {"error": f"exists: {e}"})
        except (CatalogError, LakeloomError, KeyError, ValueError) as e:
            self._answer(400, {"error": str(e)})

    def do_GET(self) -> None:
        self._route("GET")

    def do_POST(self) -> None:
        self._route("POST")

    def do_DELETE(self) -> None:
        self._route("DELETE")


def serve(catalog: Catalog, port: int = 8080, host: str = "127.0.0.1", secret: str | None = None) -> ThreadingHTTPServer:
    """A server for the catalog; the caller runs ``serve_forever`` and ``shutdown``."""
    handler = type("Handler", (_Handler,), {"catalog": catalog, "secret": secret})
    return ThreadingHTTPServer((host, port), handler)
