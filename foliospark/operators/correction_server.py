"""A corrector that asks a language model behind an HTTP server."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

INSTRUCTION = "Correct recognition errors in the text. Keep its wording, order, paragraphs and language. Answer with the corrected text alone, between <text> and </text>."


@dataclass
class Server:
    """Client of a server with /api/tags and /api/generate. It is sent to the executors as it is; each keeps whether thinking can be switched off."""

    url: str
    model: str
    timeout: float = 120.0
    options: dict = field(default_factory=lambda: {"temperature": 0})
    quiet: bool = True  # ask for no thinking

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags").get("models", [])]

    def problem(self) -> str:
        """Why the server can't be used; empty if it can. A model's name counts with and without its tag."""
        try:
            names = self.models()
        except (OSError, ValueError) as e:
            return f"the server can't be reached: {e}"
        return "" if self.model in {x for n in names for x in (n, n.partition(":")[0])} else f"the server has no model {self.model}"

    def __call__(self, text: str) -> str:
        body = {"model": self.model, "prompt": f"{INSTRUCTION}\n\n<text>\n{text}\n</text>", "stream": False, "options": self.options}
        try:
            return self._call("/api/generate", body | ({"think": False} if self.quiet else {}))["response"]
        except urllib.error.HTTPError as e:
            if e.code != 400 or not self.quiet:
                raise
        self.quiet = False  # this server doesn't know the flag
        return self(text)


def corrector_or_none(server: Server | None):  # noqa: ANN201
    """(corrector, warning): the server, or None with the reason why the pass is left out."""
    if server is None:
        return None, "no server is set"
    problem = server.problem()
    return (None, problem) if problem else (server, "")
