"""Language models behind HTTP services, for the driver. ``fetch`` opens a request and gives status, headers and lines, so
that tests and proxies can stand in for the network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

Reply = tuple[int, dict[str, str], Iterable[bytes]]


def over_http(url: str, headers: dict[str, str], body: bytes | None) -> Reply:
    try:
        r = urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=300)
        return r.status, dict(r.headers), r
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), [e.read()]


class ModelError(RuntimeError):
    """A service that can't be reached or refuses."""


@dataclass
class Service:
    """What both kinds have in common: a streamed answer is gathered, and a busy service is asked again after as long as it says,
    ``tries`` times in all."""

    url: str
    model: str
    fetch: Callable[[str, dict[str, str], bytes | None], Reply] = over_http
    tries: int = 4
    wait: float = 2.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"}

    def open(self, path: str, payload: dict | None) -> Iterable[bytes]:
        for i in range(self.tries):
            try:
                status, headers, lines = self.fetch(self.url.rstrip("/") + path, self.headers(), None if payload is None else json.dumps(payload).encode())
            except OSError as e:
                raise ModelError(f"{self.url} can't be reached: {e}") from e
            if status == 200:
                return lines
            if status not in (429, 503) or i + 1 == self.tries:
                raise ModelError(f"{self.url} answered {status}: {b''.join(lines)[:300].decode(errors='replace')}")
            told = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            self.sleep(float(told) if told.replace(".", "", 1).isdigit() else self.wait * 2**i)
        raise AssertionError

    def gather(self, pieces: Iterable[str], on_chunk: Callable[[str], None] | None) -> str:
        out = []
        for piece in pieces:
            out.append(piece)
            if on_chunk and piece:
                on_chunk(piece)
        return "".join(out)

    def send(self, messages: list[dict], on_chunk: Callable[[str], None] | None = None) -> str:
        raise NotImplementedError

    def available(self) -> bool:
        """Whether a short message is answered."""
        try:
            return bool(self.send([{"role": "user", "content": "Reply with the word ok."}]).strip())
        except ModelError:
            return False


@dataclass
class ChatCompletions(Service):
    """Services with /chat/completions and server-sent events."""

    key: str = field(default="", repr=False)

    def headers(self) -> dict[str, str]:
        return super().headers() | ({"Authorization": f"Bearer {self.key}"} if self.key else {})

    def send(self, messages: list[dict], on_chunk: Callable[[str], None] | None = None) -> str:
        def pieces() -> Iterable[str]:
            for line in self.open("/chat/completions", {"model": self.model, "messages": messages, "stream": True}):
                data = line.decode().strip().removeprefix("data:").strip()
                if data and data != "[DONE]" and line.startswith(b"data:"):
                    yield "".join(c.get("delta", {}).get("content") or "" for c in json.loads(data).get("choices", []))

        return self.gather(pieces(), on_chunk)


@dataclass
class LocalChat(Service):
    """Services on one's own machine with /api/chat and a JSON object a line."""

    def models(self) -> list[str]:
        return [m["name"] for m in json.loads(b"".join(self.open("/api/tags", None))).get("models", [])]

    def send(self, messages: list[dict], on_chunk: Callable[[str], None] | None = None) -> str:
        lines = self.open("/api/chat", {"model": self.model, "messages": messages, "stream": True})
        return self.gather((json.loads(x).get("message", {}).get("content", "") for x in lines if x.strip()), on_chunk)
