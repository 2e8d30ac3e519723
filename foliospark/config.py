"""Settings: defaults, a file's values over them, environment over both."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from typing import Any

DEFAULTS: dict[str, Any] = {
    "run.max_pages": None, "run.resume": True,
    "render.target_px": 2400, "render.min_dpi": 150, "render.max_dpi": 400,
    "preprocess.mode": "auto", "preprocess.binarize": False,
    "layout.prefer_engine_order": True, "layout.validate_engine_order": True, "layout.max_columns": 4, "layout.column_gap_ratio": 0.02,
    "assemble.strip_running_heads": True, "assemble.detect_headings": True, "assemble.dehyphenate": True, "assemble.stitch_paragraphs": True, "assemble.void_tags": True, "assemble.late_folios": True,
    "correct.enabled": True, "correct.max_chars": 4000, "correct.min_length_ratio": 0.80, "correct.max_length_ratio": 1.25, "correct.min_similarity": 0.72,
    "output.page_markers": True, "output.max_chapter_elements": 400,
}
TRUE = ("1", "true", "yes", "on")


def flat(values: dict[str, Any], under: str = "") -> dict[str, Any]:
    """Nested values by dotted path. An empty dictionary is a value."""
    out: dict[str, Any] = {}
    for name, value in values.items():
        out |= flat(value, f"{under}{name}.") if isinstance(value, dict) and value else {f"{under}{name}": value}
    return out


def nested(values: dict[str, Any]) -> dict[str, Any]:
    """Values by dotted path as dictionaries within each other."""
    heads = {path.partition(".")[0]: None for path in values}
    return {h: values[h] if h in values else nested({p[len(h) + 1 :]: v for p, v in values.items() if p.startswith(f"{h}.")}) for h in heads}


class Settings:
    """Values by dotted path; the path of a section gives all of it."""

    def __init__(self, values: dict[str, Any]) -> None:
        self.values = flat(values)

    def get(self, path: str, default: Any = None) -> Any:
        if path in self.values:
            return self.values[path]
        section = {p.removeprefix(f"{path}."): v for p, v in self.values.items() if p.startswith(f"{path}.")}
        return nested(section) if section else default

    def __getitem__(self, path: str) -> Any:
        got = self.get(path, self)
        if got is self:
            raise KeyError(path)
        return got

    def fingerprint(self, *sections: str) -> str:
        some = {s: self.get(s) for s in sections or ("render", "preprocess", "layout")}
        return hashlib.sha256(json.dumps(some, sort_keys=True).encode()).hexdigest()[:10]


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Values by dotted path, those of `over` instead of the ones at, above and below their paths."""
    out = flat(base)
    for path, value in flat(over).items():
        gone = [p for p in out if p.startswith(f"{path}.") or path.startswith(f"{p}.")]
        if value == {} and gone:
            continue  # an empty section changes nothing
        out = {p: v for p, v in out.items() if p not in gone} | {path: value}
    return out


def _read(text: str, like: Any) -> Any:
    """The text as the kind of value that stands there; fails if it is none."""
    return text.strip().lower() in TRUE if isinstance(like, bool) else type(like)(text) if isinstance(like, int | float) else text


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "FOLIOSPARK_") -> Settings:
    """Values of a JSON file, or YAML where a parser is there, over the defaults; then PREFIX_A__B from the environment.

    Unknown environment keys and numbers that can't be read are ignored.
    """
    values = dict(DEFAULTS)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        try:
            over = json.loads(text)
        except ValueError:
            import yaml

            over = yaml.safe_load(text)
        values = merged(values, over or {})
    given = {name.upper(): text for name, text in (os.environ if environ is None else environ).items()}
    for dotted, value in values.items():
        name = (prefix + dotted.replace(".", "__")).upper()
        if name in given:
            with contextlib.suppress(ValueError):
                values[dotted] = _read(given[name], value)
    return Settings(values)
