"""Models the engine calls: interfaces, and deterministic ones that need no network."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable
from typing import Protocol

from foliora.errors import ConfigurationError, ModelError


class EmbeddingModel(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def __call__(self, messages: list[dict[str, str]]) -> str: ...


class VisionModel(Protocol):
    def __call__(self, image: bytes, mime_type: str) -> str: ...


@functools.lru_cache(1 << 16)
def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big")


class HashingEmbedder:
    """Unit vectors from hashed words and pairs of characters; the same for the same text everywhere."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.size
        s = text.lower()
        for w in re.findall(r"[a-z0-9]+", s) + [s[i : i + 2] for i in range(len(s) - 1) if not s[i : i + 2].isascii()]:
            h = _hash(w)
            v[h % self.size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


class ExtractiveChat:
    """Answers with the first sentences of the context it is given; repeats a query it shall rewrite."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def __call__(self, messages: list[dict[str, str]]) -> str:
        text = messages[-1]["content"]
        _, mark, context = text.partition("Context:")
        if not mark:
            return text.strip().split("\n")[-1]
        body = re.sub(r"(?m)^\[\d+\] \[source:.*$", "", context).strip()
        parts = re.split(r"(?<=[.!?。！？])\s*", body)
        return " ".join(p.strip() for p in parts[: self.sentences] if p.strip())


class RemoteModel:
    """A chat, embedding and vision model behind a web address, in one of two dialects of requests.

    ``dialect`` is ``openai`` (chat/completions, embeddings) or ``ollama`` (api/chat, api/embed). ``post`` sends a
    payload to a path and returns the decoded answer; by default over HTTP, without proxies. An instance is an
    embedding model when called with texts; its methods ``chat`` and ``read_image`` are the other two."""

    PATHS = {"openai": ("/chat/completions", "/embeddings"), "ollama": ("/api/chat", "/api/embed")}

    def __init__(self, base_url: str, model: str, dialect: str = "openai", key: str = "", timeout: float = 60, batch: int = 50, post: Callable[[str, dict], dict] | None = None):
        if dialect not in self.PATHS:
            raise ConfigurationError(f"Unknown dialect: {dialect}")
        if not base_url or not model or batch <= 0:
            raise ConfigurationError("A remote model needs an address, a name and a batch above 0.")
        self.base_url, self.model, self.dialect, self.key, self.timeout, self.batch = base_url.rstrip("/"), model, dialect, key, timeout, batch
        self.post = post or self._post

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """Vectors of the texts in their order, however the batches of the answer are ordered."""
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            said = self.post(self.PATHS[self.dialect][1], {"model": self.model, "input": part})
            rows = said.get("embeddings") if self.dialect == "ollama" else self._in_order(said.get("data"))
            if not isinstance(rows, list) or len(rows) != len(part):
                raise ModelError(f"{len(part)} texts have {len(rows) if isinstance(rows, list) else 'no'} embeddings.")
            if any(not isinstance(v, list) or not v or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in v) for v in rows):
                raise ModelError("An embedding isn't a list of numbers.")
            out += [[float(x) for x in v] for v in rows]
        if len({len(v) for v in out}) > 1:
            raise ModelError("Embeddings differ in length.")
        return out

    @staticmethod
    def _in_order(data) -> list | None:
        if not isinstance(data, list) or not all(isinstance(d, dict) for d in data):
            return None
        places = [d.get("index", k) for k, d in enumerate(data)]
        if sorted(places) != list(range(len(data))):
            raise ModelError("The places of the embeddings aren't those of the texts.")
        return [d.get("embedding") for _, d in sorted(zip(places, data), key=lambda x: x[0])]

    def chat(self, messages: list[dict]) -> str:
        said = self.post(self.PATHS[self.dialect][0], {"model": self.model, "messages": messages, "stream": False})
        message = said.get("message") if self.dialect == "ollama" else (said.get("choices") or [{}])[0].get("message")
        if not isinstance(message, dict) or not isinstance(message.get("content"), str):
            raise ModelError("The model's answer has no content.")
        return message["content"]

    def read_image(self, image: bytes, mime_type: str) -> str:
        """The text in an image, sent in base 64; none in an empty one."""
        if not image:
            return ""
        data, ask = base64.b64encode(image).decode("ascii"), "Write down all text in this image, in its reading order and language, and nothing else."
        if self.dialect == "ollama":
            return self.chat([{"role": "user", "content": ask, "images": [data]}])
        return self.chat([{"role": "user", "content": [{"type": "text", "text": ask}, {"type": "image_url", "image_url": {"url": f"data:{mime_type};base64,{data}"}}]}])

    def _post(self, path: str, payload: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.base_url + path, json.dumps(payload).encode(), headers)
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=self.timeout) as r:
                said = json.load(r)
        except (OSError, ValueError) as e:
            raise ModelError(f"The request to the model failed: {e}") from e
        if not isinstance(said, dict):
            raise ModelError("The model's answer isn't an object.")
        return said
