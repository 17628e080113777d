"""Encoder and language model behind HTTP, on the driver or (the encoder) in Arrow batches on the executors.

The transport is a plain function, so that tests need no network; the default one is urllib's. Only transient replies (too many
requests, server errors) are asked for again, after half a second and then two; a reply that is not the JSON asked for is asked
for once more.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from ..config import validate_dim
from ..errors import CONFIG, ENCODER, LLM, MemoryError_

#: (method, url, body, headers, timeout in seconds) -> (status, body); raises OSError where no reply came.
Transport = Callable[[str, str, bytes | None, dict[str, str], float], tuple[int, bytes]]

# Seconds before the second and third attempt, replies worth another attempt, seconds for which health is believed.
DELAYS = (0.5, 2.0)
TRANSIENT = (429, 500, 502, 503, 504)
HEALTH_SECONDS = 5.0
#: Bytes of a refused reply that an error shows.
SHOWN = 1024

_FENCE = re.compile(r"\A\s*```\w*\s*\n(.*?)\n?\s*```\s*\Z", re.DOTALL)


def over_urllib(method: str, url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as refused:
        return refused.code, refused.read(SHOWN)


def web_address(address: str) -> str:
    """An http or https address without a slash at its end."""
    found = urllib.parse.urlsplit(address.strip())
    if found.scheme not in ("http", "https") or not found.netloc:
        raise MemoryError_(CONFIG, f"not an http or https address: {address!r}")
    return address.strip().rstrip("/")


def chat_address(address: str) -> str:
    """The address of chat completions, from a service's root, its /v1 or the whole path."""
    root = web_address(address).removesuffix("/chat/completions")
    return f"{root if root.endswith('/v1') else root + '/v1'}/chat/completions"


class HttpEncoder:
    """Vectors by POST /api/embed; the service answers HEAD / while it is well."""

    def __init__(self, address: str, model: str, dim: int, timeout: float = 30.0, transport: Transport = over_urllib):
        self.address, self.model, self.dim, self.timeout, self.transport = web_address(address), model, validate_dim(dim), timeout, transport
        self._asked: float | None = None
        self._well = False

    def encode(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "input": text}).encode()
        try:
            status, reply = self.transport("POST", f"{self.address}/api/embed", body, {"Content-Type": "application/json"}, self.timeout)
        except OSError as error:
            raise MemoryError_(ENCODER, "the encoder gave no reply") from error
        if not 200 <= status < 300:
            raise MemoryError_(ENCODER, f"the encoder replied {status}: {reply[:SHOWN].decode(errors='replace')}")
        try:
            vector = [float(x) for x in json.loads(reply)["embeddings"][0]]
        except (ValueError, KeyError, IndexError, TypeError) as error:
            raise MemoryError_(ENCODER, "the encoder's reply holds no vector") from error
        if len(vector) != self.dim:
            raise MemoryError_(ENCODER, f"the encoder gave {len(vector)} values instead of {self.dim}")
        return vector

    def available(self) -> bool:
        """Whether the service is well, asked at most every few seconds."""
        if self._asked is None or time.monotonic() - self._asked >= HEALTH_SECONDS:
            try:
                status, _ = self.transport("HEAD", f"{self.address}/", None, {}, HEALTH_SECONDS)
            except OSError:
                status = 0
            self._asked, self._well = time.monotonic(), 200 <= status < 300
        return self._well


class HttpModel:
    """A language model behind chat completions. Prompts of the callers are data; what form a reply must have is said here."""

    def __init__(self, address: str, model: str, key: str = "", most_tokens: int = 4096, timeout: float = 120.0,
                 transport: Transport = over_urllib, wait: Callable[[float], None] = time.sleep):
        self.address, self.model, self.key, self.most_tokens, self.timeout = chat_address(address), model, key, most_tokens, timeout
        self.transport, self.wait = transport, wait

    def chat(self, system: str, user: str) -> str:
        """The text of one reply."""
        turns = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = json.dumps({"model": self.model, "messages": turns, "max_tokens": self.most_tokens, "temperature": 0, "stream": False}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for delay in (*DELAYS, None):
            try:
                status, reply = self.transport("POST", self.address, body, headers, self.timeout)
            except OSError as error:
                raise MemoryError_(LLM, "the model gave no reply") from error
            if status not in TRANSIENT or delay is None:
                break
            self.wait(delay)
        if not 200 <= status < 300:
            raise MemoryError_(LLM, f"the model replied {status}: {reply[:SHOWN].decode(errors='replace')}")
        try:
            return json.loads(reply)["choices"][0]["message"]["content"] or ""
        except (ValueError, KeyError, IndexError, TypeError) as error:
            raise MemoryError_(LLM, "the model's reply holds no choice") from error

    def _json(self, system: str, user: str, kind: type):
        """The reply as JSON of one kind, without the fence that models like to put around it."""
        for _ in range(2):
            reply = self.chat(system, user)
            fenced = _FENCE.match(reply)
            try:
                found = json.loads(fenced[1] if fenced else reply)
            except ValueError:
                continue
            if isinstance(found, kind):
                return found
        raise MemoryError_(LLM, f"the model's reply is no JSON {'object' if kind is dict else 'array'}")

    def keywords(self, text: str) -> list[str]:
        found = self._json("Reply with a JSON array of the text's key terms as strings, and with nothing else.", text, list)
        return list(dict.fromkeys(w.strip() for w in found if isinstance(w, str) and w.strip()))

    def consolidate(self, prompt: str) -> list[dict]:
        asked = "Group topics that tell one story. Reply with a JSON array of objects with node_hashes (identifiers) and merged_summary; [] if none."
        return [g for g in self._json(asked, prompt, list) if isinstance(g, dict)]

    def distill(self, prompt: str) -> dict:
        asked = ("Read feelings and type from the samples. Reply with a JSON object: emotion (valence, arousal, dominance in 0..1), mbti (ie, ns, tf, jp in "
                 "-1..1), per_node (an array of id_hex, valence, arousal).")  # fmt: skip
        return self._json(asked, prompt, dict)

    def crystallize(self, prompt: str) -> list[dict]:
        asked = "Find abilities worth keeping in the events. Reply with a JSON array of capability objects; [] if none."
        return [c for c in self._json(asked, prompt, list) if isinstance(c, dict)]
