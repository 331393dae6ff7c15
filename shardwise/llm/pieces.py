"""Cutting texts where no tokenizer of this family can join, and remembering what was encoded.

Byte-level vocabularies split a text by a pattern before they merge. In that pattern a single space
between two characters that are not white space always opens a new part, so a text may be cut before each
such space and the parts encoded one by one. Words repeat; each worker remembers what it has encoded.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

import numpy as np

#: Entries a worker remembers before it forgets all: bounds its memory, never its results.
REMEMBERED = 400_000
#: Characters whose parts are held together; a longer text is held alone.
AT_ONCE = 1 << 20

# Both begin with the space itself, which is searched fast.
_AWKWARD = re.compile(r" (?:\s|(?<=\s ))")
_CUT = re.compile(r" (?<=\S )(?=\S)")


def cut(text: str) -> list[str]:
    """Parts of the text; every part but the first follows one space."""
    if not text or text[0].isspace() or text[-1].isspace() or _AWKWARD.search(text):
        return _CUT.split(text)
    return text.split(" ")


def worker_store(name: str, make: Callable[[], object]) -> object:
    """An object made once in each Python worker and kept between its tasks."""
    store = sys.modules.setdefault("llm_worker_store", types.ModuleType("llm_worker_store"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


class Remembering:
    """Encodes texts through `encode`, which takes a list of distinct parts and returns bytes for each."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED, at_once: int = AT_ONCE):
        self.encode, self.limit, self.at_once = encode, limit, at_once
        self.inner: dict[str, bytes] = {}  # parts that follow a space
        self.first: dict[str, bytes] = {}  # parts that open a text

    def texts(self, texts: list[str]) -> list[bytes]:
        """Some characters' worth of texts at a time: their parts are far larger than the texts themselves."""
        out, begin, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= self.at_once:
                out += self._some(texts[begin : i + 1])
                begin, size = i + 1, 0
        return out + self._some(texts[begin:])

    def _some(self, texts: list[str]) -> list[bytes]:
        inner, first = self.inner, self.first
        parts = [cut(t) for t in texts]
        new = set().union(*parts) - inner.keys() if parts else set()
        inner.update(zip(new, self.encode([f" {w}" for w in new]), strict=True))
        new = {p[0] for p in parts} - first.keys()
        first.update(zip(new, self.encode(list(new)), strict=True))
        out = []
        for p in parts:
            encoded = list(map(inner.__getitem__, p))
            encoded[0] = first[p[0]]
            out.append(b"".join(encoded))
        for known in (inner, first):
            if len(known) > self.limit:
                known.clear()
        return out


def forget_parts() -> None:
    """Drop what this worker's encoders remember, at the end of a task: few parts serve a later one, and the worker stays."""
    for kept in vars(sys.modules.get("llm_worker_store", types)).values():
        if isinstance(kept, Remembering):
            kept.inner.clear()
            kept.first.clear()


class Decoder:
    """Ids, as bytes of little-endian unsigned 32-bit integers, to the bytes of their tokens."""

    def __init__(self, tokens: dict[int, bytes]):
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.length = np.array([len(t) for t in every], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(every), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        length = self.length[tokens]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        at = np.repeat(self.start[tokens] - (ends - length), length) + np.arange(ends[-1])
        return self.all[at].tobytes()
