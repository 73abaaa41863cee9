"""A chat service that answers in JSON, as a call for scorer.scored()."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

#: What the service is told before a prompt, and how it is to answer.
SYSTEM = "You are a strict JSON-only scoring assistant. Follow the research scope exactly."
OPTIONS = {"temperature": 0, "seed": 42, "num_ctx": 4096, "num_predict": 192}


class ChatError(Exception):
    """A request that failed, with what the service said."""


@dataclass(frozen=True)
class Chat:
    """Called with a prompt, returns (answer, prompt tokens that the service counted). It has no open state, so tasks can carry it."""

    url: str
    model: str
    timeout: float = 600.0
    options: dict = field(default_factory=lambda: dict(OPTIONS))

    def __call__(self, prompt: str, attempt: int) -> tuple[str, int | None]:
        messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "stream": False, "format": "json", "keep_alive": -1, "options": self.options}
        try:
            told = self.request(body | {"think": False})
        except ChatError as e:
            if "think" not in str(e).lower():
                raise
            told = self.request(body)  # a model that knows no such switch
        count = told.get("prompt_eval_count")
        return str((told.get("message") or {}).get("content") or ""), count if isinstance(count, int) else None

    def request(self, body: dict) -> dict:
        asked = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as f:
                said = f.read().decode("utf-8", errors="replace")
        except urllib.error.HTTPError as e:
            raise ChatError(f"HTTP {e.code}: {e.read().decode('utf-8', errors='replace')}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise ChatError(str(e)) from e
        try:
            told = json.loads(said) if said.strip() else {}
        except ValueError as e:
            raise ChatError(f"no JSON: {said[:500]}") from e
        return told if isinstance(told, dict) else {}
