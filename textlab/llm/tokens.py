"""Token ids of whole texts with a public tokenizer, each distinct chunk encoded once per worker.

A chunk is a piece of text that the tokenizer's own pre-tokenizer never joins with its neighbours, so encoding chunks
one by one gives the ids of the whole text. Where that is not certain the whole text goes to the library.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Chunks, and words without marks, whose ids a worker remembers (some 100 MB each). A full memory forgets its later half:
#: what is frequent was met early. Between tasks it holds fewer: the next one may be of a stage that wants the memory.
CACHE_CHUNKS = 600_000
IDLE_CHUNKS = 100_000


def _forget(known: dict, keep: int) -> None:
    for key in list(islice(known, keep, None)):
        del known[key]


#: A word of Latin letters, maybe with marks after it: the pre-tokenizers cut it there, and in its letters (all of them
#: composed, each with one small form) normalising is lower-casing.
_PLAIN = re.compile(r"( ?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """``encode(text)``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as little-endian uint32 bytes.

    How texts are cut follows the file's pre-tokenizer: *words* (white space is dropped by it: cut at ASCII white
    space), *spaced* (byte-level with a space kept before each word: cut at single spaces and newlines between
    other characters), else *whole*.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.mode, self.cache_chunks = self._mode(spec), cache_chunks
        self.cache: dict[str | bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        if self.mode == "spaced":                             # never encoded with others: it parts them
            (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.cache["\n"] = np.array([self.newline], "<u4").tobytes()

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaced"
        steps = pre.get("pretokenizers") or []
        if (steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
                and {s["type"] for s in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
                and not steps[1].get("add_prefix_space")):
            return "words"
        return "whole"

    def _chunks(self, text: str) -> list[str] | list[bytes] | None:
        if self.mode == "words":
            return text.encode().split()
        if self.mode == "spaced" and "\x00" not in text:
            parts = text.split()                                       # any white space, a superset of the library's
            if " ".join(parts) == text.replace("\n", " "):
                return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return None

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, already normalised, from the library's model."""
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() and part[0] != " " else part.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.parts) > self.cache_chunks:
                _forget(self.parts, self.cache_chunks // 2)
            self.parts[part] = ids
        return ids

    def _encode_all(self, chunks: list[str] | list[bytes]) -> list[bytes]:
        """Ids of every chunk: plain words from the library's model, the rest as one text dealt back by character offsets."""
        if self.mode == "words":
            chunks = [c.decode("utf-8", "replace") for c in chunks]
        out: list[bytes | None] = []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                out.append(self._part(chunk.lower() if self.mode == "words" else chunk))
                continue
            m = _PLAIN.fullmatch(chunk)
            if m is None:
                out.append(None)
                continue
            space, word, marks = m.groups()
            ids = self._part(word.lower() if self.mode == "words" else space + word)
            out.append(ids + self._part(marks) if marks else ids)
        rest = [c for c, ids in zip(chunks, out) if ids is None]
        if rest:
            found = iter(self._encode_joint(rest))
            out = [next(found) if ids is None else ids for ids in out]
        return out

    def _encode_joint(self, chunks: list[str]) -> list[bytes]:
        if self.mode == "words":
            joint, drop = " ", -1
        else:
            joint, drop = "\n", self.newline
        e = self.tokenizer.encode(joint.join(chunks), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        at = np.array([a for a, _ in e.offsets], np.int64)
        if drop >= 0:
            keep = ids != drop
            ids, at = ids[keep], at[keep]
        begin = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        cut = np.searchsorted(at, begin).tolist()
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(cut, cut[1:])]

    def trim(self, keep: int) -> None:
        """Forgets all but the ``keep`` chunks and words that were met first: what a worker holds between tasks."""
        _forget(self.cache, keep)
        _forget(self.parts, keep)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = self._chunks(text)
        return self._ids(text) if chunks is None else self._look_up(chunks)

    def encode_words(self, text: bytes, words: list[bytes]) -> bytes:
        """``encode`` of a text whose words at ASCII white space are at hand."""
        return self._look_up(words) if self.mode == "words" else self.encode(text.decode("utf-8", "replace"))

    def _look_up(self, chunks: list[str] | list[bytes]) -> bytes:
        known = self.cache
        found = list(map(known.get, chunks))                           # once: most of the time goes on reaching the entries
        if None in found:
            new = list(dict.fromkeys(c for c, ids in zip(chunks, found) if ids is None))
            fresh = dict(zip(new, self._encode_all(new)))
            if len(known) + len(new) > self.cache_chunks:
                _forget(known, self.cache_chunks // 2)
            known.update(fresh)
            found = [fresh[c] if ids is None else ids for c, ids in zip(chunks, found)]
        return b"".join(found)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file (kept while the worker lives)."""
    return Encoder(path)


@contextlib.contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The worker's encoder for the time of a task; afterwards it keeps only what was met first."""
    one = encoder(path)
    try:
        yield one
    finally:
        one.trim(IDLE_CHUNKS)


def public_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
