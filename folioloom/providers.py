"""Interfaces of external models, and deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache
from typing import Protocol


class Embedder(Protocol):
    """Turns texts into vectors of one width and length 1; a pure function of the text."""

    name: str
    width: int

    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class Splitter(Protocol):
    """Splits one paragraph into sentences."""

    def split(self, paragraph: str) -> list[str]: ...


class Vision(Protocol):
    """Describes a batch of asset files in the four-field form."""

    name: str

    def describe(self, filenames: Sequence[str], prompt: str) -> str: ...


class Answerer(Protocol):
    """Answers a rendered prompt."""

    name: str

    def answer(self, prompt: str, images: Sequence[str]) -> str: ...


class Renderer(Protocol):
    """Cuts a region out of a page and returns PNG bytes."""

    def render(self, source: str, page_index: int, crop: Sequence[float], size: Sequence[float]) -> bytes: ...


@lru_cache(maxsize=200_000)
def _hashed(word: str) -> tuple[int, float]:
    """A number and a sign for a word, from its MD5."""
    digest = hashlib.md5(word.encode("utf-8")).digest()
    return int.from_bytes(digest[:4], "big"), 1.0 if digest[4] & 1 else -1.0


class HashedWords:
    """Bag of words hashed into ``width`` signed dimensions, of length 1; an empty text is all zeros."""

    def __init__(self, width: int = 64):
        self.width = width
        self.name = f"hashed-words-{width}"

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.width
            for word in re.findall(r"\w+", (text or "").lower()):
                number, sign = _hashed(word)
                vector[number % self.width] += sign
            norm = sum(v * v for v in vector) ** 0.5
            out.append([v / norm for v in vector] if norm else vector)
        return out


class DryVision:
    """Returns placeholder descriptions for every file it is asked about; their words are fixed values."""

    name = "dry-run"

    def describe(self, filenames: Sequence[str], prompt: str) -> str:
        return "\n\n".join("\n".join((f"[F] {name}", "[T] DRY RUN", "[M] Dry run metadata.", "[C] Dry run content.")) for name in filenames)


class DryAnswerer:
    """Returns a fixed sentence with the key of the prompt."""

    name = "dry-run"

    def answer(self, prompt: str, images: Sequence[str]) -> str:
        return f"Dry run answer {hashlib.md5(prompt.encode('utf-8')).hexdigest()[:8]}"
