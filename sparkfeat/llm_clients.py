"""Backends of suggested features: HTTP services of the common chat shape, another library's client, or the offline mock.

A backend is anything with ``complete(prompt) -> str``.  What cannot be reached is replaced by the mock, with a warning.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable

from .semantic import LLM, MockLLM

SYSTEM = "You suggest columns computed from tabular data. Answer with one JSON object only."


class ChatClient:
    """A service that takes {model, messages} and answers {choices: [{message: {content}}]}.

    The key comes from the environment variable that ``key_env`` names and goes into ``key_header``, as a bearer token if that is Authorization.
    """

    def __init__(self, url: str, model: str, key_env: str = "LLM_API_KEY", key_header: str = "Authorization", headers: dict[str, str] | None = None, timeout: float = 60.0, temperature: float = 0.3, send: Callable[[urllib.request.Request, float], bytes] | None = None) -> None:
        self.key_header = key_header
        self.url, self.model, self.key_env, self.headers, self.timeout, self.temperature = url, model, key_env, headers or {}, timeout, temperature
        self.send = send or self._send

    @staticmethod
    def _send(request: urllib.request.Request, timeout: float) -> bytes:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read()

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]}
        key = os.environ.get(self.key_env)
        head = {"Content-Type": "application/json", **({self.key_header: f"Bearer {key}" if self.key_header == "Authorization" else key} if key else {}), **self.headers}
        reply = json.loads(self.send(urllib.request.Request(self.url, json.dumps(body).encode(), head), self.timeout))
        return reply["choices"][0]["message"]["content"]


class LibraryClient:
    """Any installed library's completion function, called with (model, messages)."""

    def __init__(self, completion: Callable, model: str) -> None:
        self.completion, self.model = completion, model

    def complete(self, prompt: str) -> str:
        reply = self.completion(model=self.model, messages=[{"role": "user", "content": prompt}])
        return reply["choices"][0]["message"]["content"]


class Fallback:
    """A backend whose failures are answered by the mock; ``failed`` keeps the last reason."""

    def __init__(self, first: LLM, second: LLM | None = None) -> None:
        self.first, self.second, self.failed = first, second or MockLLM(), None

    def complete(self, prompt: str) -> str:
        try:
            return self.first.complete(prompt)
        except (OSError, urllib.error.URLError, KeyError, IndexError, ValueError) as e:
            self.failed = str(e)
            warnings.warn(f"the language model is not available, the mock answers: {e}", UserWarning, stacklevel=2)
            return self.second.complete(prompt)


BACKENDS = ("mock", "chat", "library")


def client(backend: str = "mock", **how) -> LLM:
    """A backend by name; all but the mock fall back to it."""
    made = {"mock": MockLLM, "chat": ChatClient, "library": LibraryClient}
    if backend not in made:
        raise ValueError(f"backend is one of {BACKENDS}")
    return MockLLM() if backend == "mock" else Fallback(made[backend](**how))


class Models:
    """Model names of a backend; without a list every name is taken as valid."""

    def __init__(self, fetch: Callable[[], list[dict]] | None = None) -> None:
        self._fetch, self._known = fetch, None

    def fetch(self) -> list[dict]:
        if self._known is None:
            try:
                self._known = self._fetch() if self._fetch else [{"id": m} for m in MockLLM.models]
            except (OSError, ValueError) as e:
                warnings.warn(f"no list of models: {e}", UserWarning, stacklevel=2)
                self._known = []
        return self._known

    def names(self) -> list[str]:
        return [m["id"] for m in self.fetch()]

    def info(self, name: str) -> dict | None:
        return next((m for m in self.fetch() if m["id"] == name), None)

    def is_valid(self, name: str) -> bool:
        return not self.fetch() or name in self.names()
