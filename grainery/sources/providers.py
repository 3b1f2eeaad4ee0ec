"""Providers of vectors, headings and grades. A model behind a network is one more class of the same shape."""

from __future__ import annotations

import hashlib
import json
import math
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from grainery.functions import segmentation

# fixed values: the vector width, texts of one request, and the two instructions before a text
WIDTH, BATCH = 768, 64
PREFIXES = {"document": "title: none | text: ", "query": "task: search result | query: "}

#: Seconds that a model server may take, and characters of its answer that an error quotes.
PATIENCE, QUOTED = 180, 500


class Failed(Exception):
    """Why a provider gave no vectors."""


@dataclass(frozen=True)
class Off:
    """No vectors: search goes by keywords, snippets keep null vectors."""

    model: str = "off"
    width: int = WIDTH

    def vectors(self, texts: list[str]) -> list[list[float]]:
        raise Failed("embedding is off")


@dataclass(frozen=True)
class Hashed:
    """Deterministic vectors of hashed words, for tests and offline use."""

    width: int = WIDTH
    model: str = "hashed-words"

    def vectors(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.width
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.width] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


def _ask(url: str, body: dict, key: str) -> list:
    """What a model server's JSON answer holds under a key."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310
    try:
        with urllib.request.urlopen(asked, timeout=PATIENCE) as answer:  # noqa: S310
            return json.load(answer)[key]
    except urllib.error.HTTPError as error:
        raise Failed(f"the model server answered {error.code}: {error.read().decode(errors='replace')[:QUOTED]}") from error
    except urllib.error.URLError as error:
        raise Failed(f"no model server at {url}: {error.reason}") from error
    except (ValueError, KeyError, TypeError) as error:
        raise Failed(f"the model server's answer has no {key}: {error}") from error


@dataclass(frozen=True)
class Server:
    """Vectors of a model server: one POST of {model, input} for each request, answered by {embeddings}."""

    url: str
    model: str
    width: int = WIDTH

    def vectors(self, texts: list[str]) -> list[list[float]]:
        return _ask(self.url, {"model": self.model, "input": texts}, "embeddings")


@dataclass(frozen=True)
class HeadingServer:
    """Heading proposals of a model server: a POST of {model, prompt, input} for each attempt, answered by {points}; none if it fails."""

    url: str
    model: str
    base: str = "Propose headings for the numbered units."

    def __call__(self, units, kind, feedback, chapters) -> list | None:
        prompt = segmentation.compose_prompt(self.base, kind, chapters=segmentation.render_chapters(chapters), feedback=feedback)
        try:
            return _ask(self.url, {"model": self.model, "prompt": prompt, "input": segmentation.render_units(units)}, "points")
        except Failed:
            return None


@dataclass(frozen=True)
class JudgeServer:
    """Grades of a model server: a POST of {model, input} for each document, answered by {verdicts}; none if it fails."""

    url: str
    model: str

    def grade(self, sections: list[tuple[int, str, str]]) -> list[dict]:
        try:
            found = _ask(self.url, {"model": self.model, "input": [{"before_unit": b, "heading": h, "text": t} for b, h, t in sections]}, "verdicts")
        except Failed:
            return []
        return [{c: v.get(c) for c in ("before_unit", "score", "grade", "reasoning", "excerpt")} for v in found]


def provider(name: str | None, url: str = "", model: str = "") -> Off | Hashed | Server:
    """The provider of a setting: `off`, `hashed` or `server`."""
    match name:
        case None | "off":
            return Off()
        case "hashed":
            return Hashed()
        case "server":
            return Server(url, model)
    raise Failed(f"unknown provider {name!r}")


def checked(vectors: list, texts: list[str], width: int) -> list:
    """Vectors only if there is one of the right width for each text."""
    if len(vectors) != len(texts):
        raise Failed(f"{len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != width:
            raise Failed(f"a vector of width {len(v)} in place of {width}")
    return vectors


def embed(source, texts: list[str], kind: str = "document") -> dict:
    """ok, vectors and model, or ok and error: texts with the instruction of their kind before them, a request at a time."""
    try:
        if not texts:
            raise Failed("no texts")
        if kind not in PREFIXES:
            raise Failed(f"unknown kind of text {kind!r}")
        found: list = []
        for lo in range(0, len(texts), BATCH):
            found += source.vectors([PREFIXES[kind] + (t or "") for t in texts[lo : lo + BATCH]])
        return {"ok": True, "vectors": checked(found, texts, source.width), "model": source.model}
    except Failed as why:
        return {"ok": False, "error": str(why), "model": source.model}


def embedded(source, texts: list[str], kind: str = "document") -> list | None:
    """The vectors, or null if anything went wrong: a row is written without one and filled in later."""
    try:
        return embed(source, texts, kind).get("vectors")
    except Exception:  # noqa: BLE001  a provider is foreign code
        return None


def read_settings(path: str) -> dict[str, str]:
    """NAME=value lines of a file, unquoted, under the exported values, which win; other lines and a missing file count for nothing."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for name, equals, value in (x.strip().partition("=") for x in lines):
                if equals and name and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"").strip("'")
    return found | {k: v for k, v in os.environ.items() if k in found}


@dataclass
class Scripted:
    """Heading proposals given beforehand: one list per attempt."""

    attempts: list
    asked: list = field(default_factory=list)

    def __call__(self, units, kind, feedback, chapters):
        self.asked.append(feedback)
        return self.attempts[min(len(self.asked), len(self.attempts)) - 1] if self.attempts else None


@dataclass(frozen=True)
class ScriptedJudge:
    """Grades by heading; no call is made for an empty list."""

    scores: dict

    def grade(self, sections: list[tuple[int, str, str]]) -> list[dict]:
        return [{"before_unit": b, "score": self.scores.get(h), "grade": "scripted", "reasoning": "", "excerpt": text[:60]} for b, h, text in sections]
