"""Model services over HTTP: chat completion and embeddings, with backoff.

The interfaces are those of ``enrichment.Model`` and ``embedding.EmbeddingProvider``.
A service is a value that can be sent to workers; the transport is a function of
(url, headers, body, timeout) that gives a status and a body, so tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from lodestone import schemas as S

Transport = Callable[[str, dict, bytes, float], tuple[int, bytes]]
TOO_MANY = 429


class ServiceError(RuntimeError):
    """A service that answers with an error, or not at all."""


def http_post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@dataclass(frozen=True)
class Service:
    """Where a model is served. ``order``: routing preference; ``only``: whether others may not serve."""

    key: str
    model: str
    base_url: str
    retries: int = 2
    order: tuple[str, ...] = ()
    only: bool = False
    transport: Transport = http_post
    sleep: Callable[[float], None] = time.sleep

    def call(self, path: str, body: dict, timeout: float, needs: str, patient: bool) -> dict:
        """The answer's JSON, which must have the key ``needs``. Rate limits and broken connections are tried again after 1, 2, 4, ... seconds; with ``patient`` so is every other failure."""
        if not self.key:
            raise ValueError("no API key is set")
        routed = {"provider": {"order": list(self.order)} | ({"allow_fallbacks": False} if self.only else {})} if self.order else {}
        sent = json.dumps({"model": self.model} | body | routed).encode()
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        for attempt in range(self.retries + 1):
            final = not patient
            try:
                status, answer = self.transport(f"{self.base_url}/{path}", headers, sent, timeout)
                final = final and status != TOO_MANY
                if status >= 400:
                    raise ServiceError(f"status {status}: {answer[:200].decode(errors='replace')}")
                found = json.loads(answer)
                if needs not in found:  # services report errors with status 200, too
                    raise ServiceError(f"no {needs} in the answer: {str(found)[:200]}")
                return found
            except Exception as e:
                broken = not isinstance(e, (ServiceError, ValueError))
                if attempt == self.retries or final and not broken:
                    raise e if isinstance(e, ServiceError) else ServiceError(f"{type(e).__name__}: {e}") from e
            self.sleep(2**attempt)
        raise AssertionError("not reached")


@dataclass(frozen=True)
class ChatService(Service):
    """A chat model; calling it gives the text of its answer."""

    options: dict = field(default_factory=dict)
    timeout: float = 120.0

    def __call__(self, messages: list[dict]) -> str:
        answer = self.call("chat/completions", {"messages": messages} | self.options, self.timeout, "choices", patient=True)
        return answer["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class EmbeddingService(Service):
    """An embedding model; vectors come in the order of the texts."""

    dimension: int = S.VECTOR_SIZE

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = self.call("embeddings", {"input": texts, "encoding_format": "float"}, 30.0 + 10.0 * len(texts), "data", patient=False)
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]
