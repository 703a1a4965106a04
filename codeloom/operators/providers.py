"""Hosted embedding services behind ``vectors.Provider``: one HTTP class, a request shape for each service."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

#: Seconds that a request may take.
TIMEOUT, LOCAL_TIMEOUT = 60, 120


@dataclass
class HttpProvider:
    """Posts ``{"model": ..., "input": [texts]}`` with ``extra`` to ``url``; ``vectors_of`` reads the answer."""

    name: str
    model: str
    url: str
    vectors_of: Callable[[dict], list[list[float]]]
    key: str | None = None
    extra: dict = field(default_factory=dict)
    timeout: int = TIMEOUT

    def embed(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": list(texts), **self.extra}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
            out = self.vectors_of(json.load(answer))
        if len(out) != len(texts):
            raise ValueError(f"{self.name} sent {len(out)} vectors for {len(texts)} texts")
        return [[float(x) for x in v] for v in out]


def _indexed(answer: dict) -> list[list[float]]:
    return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]


def _listed(answer: dict) -> list[list[float]]:
    return answer["embeddings"]


def connect(name: str, model: str, dimensions: int | None = None, env: dict[str, str] | None = None) -> HttpProvider:
    """The hosted provider of this name, with its key and address from the environment."""
    env = os.environ if env is None else env
    size = {"dimensions": dimensions} if dimensions else {}
    if name == "voyage":
        return HttpProvider(name, model, "https://api.voyageai.com/v1/embeddings", _indexed, env.get("VOYAGE_API_KEY"), {"output_dimension": dimensions} if dimensions else {})
    if name == "openai":
        return HttpProvider(name, model, "https://api.openai.com/v1/embeddings", _indexed, env.get("OPENAI_API_KEY"), size)
    if name == "openai-compatible":
        base = env.get("CODELOOM_EMBED_BASE_URL")
        if not base:
            raise ValueError("CODELOOM_EMBED_BASE_URL names the service's address")
        return HttpProvider(name, model, base.rstrip("/") + "/embeddings", _indexed, env.get("CODELOOM_EMBED_API_KEY"), size)
    if name == "ollama":
        return HttpProvider(name, model, env.get("OLLAMA_HOST", "http://localhost:11434").rstrip("/") + "/api/embed", _listed, timeout=LOCAL_TIMEOUT)
    raise ValueError(f"no hosted provider of this name: {name}")
