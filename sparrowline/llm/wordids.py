"""Token ids of whole texts, as the tokenizers library gives them, by way of
each worker's table of distinct words.

Where a tokenizer drops white space before it merges, no token crosses ASCII
white space, so each distinct word between such spaces is encoded once and the
ids are joined back by position. A word of Latin letters, digits and signs is
first split by the tokenizer's own pattern, and its parts are merged by the
library's model; any other word, and any that may hold a special token, goes
through the whole library. For a tokenizer of another kind each text goes
through the library as it is.
"""

from __future__ import annotations

import json
import re
from struct import pack as _pack

import numpy as np

#: Words and parts that a worker keeps, and the longest it keeps (bytes).
KEEP, KEEP_BYTES = 400_000, 48

# The pre-tokenizer's pattern that the split below answers to, and the letters among U+00C0..U+00FF in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zß-öø-ÿ"

_plain = re.compile("[!-~À-ÿ]*").fullmatch
_parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if
    it prints, else the next letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": PATTERN}
        self.by_word = self.by_word and not steps[1]["add_prefix_space"] and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.special = [t["content"][:2] for t in spec["added_tokens"]]
        self.letters, self.merge = _byte_letters(), self.tokenizer.model.tokenize
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            text = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.merge(text)]
            got = _pack(f"<{len(ids)}I", *ids)
            if len(p) <= KEEP_BYTES:
                if len(self.parts) >= KEEP:
                    self.parts.clear()
                self.parts[p] = got
        return got

    def _learn(self, new: list[bytes]) -> None:
        rest = []
        for w in new:
            s = w.decode()
            if _plain(s) and not any(x in s for x in self.special):
                self.words[w] = b"".join([self._part(p) for p in _parts(s.lower())])
            else:
                rest.append((w, s))
        for (w, _), ids in zip(rest, self._whole([s for _, s in rest]), strict=True):
            self.words[w] = ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._whole([t.decode() for t in texts])
        split = [t.split() for t in texts]
        need: set[bytes] = set()
        for s in split:
            need.update(s)
        words = self.words
        new = [w for w in need if w not in words]
        if len(words) + len(new) > KEEP:
            words.clear()
            new = list(need)
        self._learn(new)
        out = [b"".join([words[w] for w in s]) for s in split]
        for w in new:
            if len(w) > KEEP_BYTES:
                del words[w]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
