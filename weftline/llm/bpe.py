"""Byte-level BPE on executors: exact pre-tokens, encoding, decoding."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Letters, numbers and white space among the first 256 characters.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\v\f\r \x85\xa0"
#: The pre-token pattern of byte-level BPE, for texts of these characters.
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Distinct pre-tokens after which an encoder begins to forget.
REMEMBER = 200_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in out)
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def _four_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _check(file: dict) -> None:
    """Raises where the file asks for another splitting than PATTERN or for changes of the text."""
    split = file.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and file["model"]["type"] == "BPE" and not file.get("normalizer")
    if not plain or any(x.get(f) for x in file["added_tokens"] for f in ("single_word", "lstrip", "rstrip")):
        raise ValueError("the tokenizer is no plain byte-level BPE")


class Encoder:
    """One tokenizer of the ``tokenizers`` library, from its JSON."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        added = json.loads(source)["added_tokens"]
        _check(json.loads(source))
        self.special = [x["content"] for x in added]
        self.longest_special = max((len(x.encode()) for x in self.special), default=0)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.special_ids = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        to_byte = _byte_of()
        self.bytes_of: list[bytes] = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            known = token not in self.special and all(c in to_byte for c in token)
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.length_of = np.array([len(x) for x in self.bytes_of])

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a text."""
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian unsigned 32-bit integers.

        Each distinct pre-token goes through the library once while it is remembered.
        """
        plain = [self._segments(text) for text in texts]
        memory = self._remembered(set().union(*(tokens for segments in plain for tokens, _ in segments)))
        out = []
        for segments in plain:
            parts = []
            for tokens, special in segments:
                parts += map(memory.__getitem__, tokens)
                parts.append(special)
            out.append(b"".join(parts))
        return out

    def _segments(self, text: str) -> list[tuple[list[str], bytes]]:
        """The pre-tokens between special strings, each with the id of the special string after it."""
        if not (self.split and any(s in text for s in self.special)):
            return [(self._plain(text), b"")]
        after = [self.special_ids[s] for s in self.split.findall(text)] + [b""]
        return [(self._plain(x), s) for x, s in zip(self.split.split(text), after, strict=True)]

    def _remembered(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of at least these pre-tokens. When too many are known, those not met since the last time are dropped."""
        if len(self.memory) > REMEMBER:
            self.old, self.memory = self.memory, {}
        new = tokens.difference(self.memory)
        known = {t for t in new if t in self.old}  # the few new ones, not the many old ones, are gone through
        self.memory.update((t, self.old[t]) for t in known)
        new = list(new - known)
        for i in range(0, len(new), 2000):
            found = self.library.encode_batch_fast(new[i : i + 2000], add_special_tokens=False)
            self.memory.update((t, _four_bytes(e.ids)) for t, e in zip(new[i : i + 2000], found, strict=True))
        return self.memory

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the library decodes to, special tokens kept."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").encode()

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens that the text spells out."""
        if self.split and any(s in text for s in self.special):
            out, segments = [], self.split.split(text)
            for segment in segments:
                out += self._plain(segment)
            return out, len(segments) - 1
        return self._plain(text), 0

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # leave rarer characters to the library's own tables
            data = text.encode()
            out, at = [], 0
            for token, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
                out.append(data[at : at + len(token)].decode())  # a character of the token is a byte of the text
                at += len(token)
            return out
        return PATTERN.findall(text)

    def piece_counts(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        out: list[int] = []
        for i in range(0, len(pre_tokens), 2000):
            out += [len(e.ids) for e in self.library.encode_batch_fast(pre_tokens[i : i + 2000], add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(source)


def read_tokenizer(path: str) -> str:
    """The file's text, which is broadcast (a vocabulary has a fixed size of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
