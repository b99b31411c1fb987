"""HTTP service over a searcher and an agent: GET /health, POST /v1/ask, POST /v1/agent."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class ModelError(RuntimeError):
    """The language model failed: the service's own state is fine."""


@dataclass(frozen=True)
class Resources:
    """What requests are answered with: ask(question, language or None, k) and agent(question, language or None, thread id or None)."""

    ask: Callable[[str, str | None, int | None], dict]
    agent: Callable[[str, str | None, str | None], dict]
    info: dict


def handle(resources: Resources, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and reply of a request. Wrong input is 422, a model's failure 502."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", **resources.info}
    if method != "POST" or path not in ("/v1/ask", "/v1/agent"):
        return 404, {"detail": "no such path"}
    try:
        asked = json.loads(body)
        question, language, k = asked["question"], asked.get("language"), asked.get("k")
    except (ValueError, KeyError, TypeError, AttributeError):
        return 422, {"detail": "a JSON object with a question is expected"}
    if not isinstance(question, str) or not question.strip():
        return 422, {"detail": "the question is empty"}
    if language not in (None, "en", "fr"):
        return 422, {"detail": "language is en or fr"}
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 20):
        return 422, {"detail": "k is from 1 to 20"}
    try:
        return 200, resources.ask(question, language, k) if path == "/v1/ask" else resources.agent(question, language, asked.get("thread_id"))
    except ModelError as e:
        return 502, {"detail": str(e)}


def server(resources: Resources, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, reply = handle(resources, self.command, self.path.split("?")[0], body)
            raw = json.dumps(reply, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
