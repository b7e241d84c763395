"""Which parts of a text a word-wise vocabulary file encodes independently of each other.

Made for tokenizer files that compose to NFC, fold white space, lower the case and then split by a
pattern that never holds white space. In texts of ASCII and precomposed Latin letters these steps act on
each white-space separated word alone, so words can be memoised. All other texts, and the library's
special strings, take the library's own steps.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

# The characters of the plain path. No control characters besides white space, nothing that
# composes, and no letter whose lower case depends on its place or has another length.
PLAIN = re.compile(r"[\t-\r -~¡-įı-ſ]*")


# Fixed value: the split pattern that `tokens_of_word` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Marks that end many words; the split pattern makes each a pre-token of its own after letters.
STOPS = ".,;:!?"

# Kinds of the characters of the plain path, as the split pattern tells them apart: white, letter, number, other.
WHITE, LETTER, NUMBER, OTHER = range(4)


def _kind(c: str) -> int:
    return next((k for k, p in ((WHITE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")) if regex.match(p, c)), OTHER)


KINDS = np.array([_kind(chr(c)) for c in range(0x180)], np.uint8)


def plain_segments(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pre-tokens of plain texts, in lower case, and the runs of white space between them, in one array; and the
    number of the first one of each text, with the end.

    The same split as that of `PATTERN`, by the kinds of neighbouring bytes; a character beyond ASCII has two. Between
    two texts stands a line end, so that nothing reaches over.
    """
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b"\n"]), np.uint8)
    kind = KINDS[data]
    wide = np.flatnonzero(data >= 0xC0)
    kind[wide] = kind[wide + 1] = KINDS[(data[wide].astype(np.int32) & 0x1F) << 6 | data[wide + 1] & 0x3F]
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begins[wide + 1] = False
    # 's, 't, 'm, 'd, 're, 've and 'll are one, where the match begins with the apostrophe.
    mark = np.flatnonzero((data == ord("'")) & begins)
    mark = mark[kind[mark + 1] == LETTER]
    one, two = data[mark + 1], data[mark + 2]
    size = np.isin(one, list(b"stmd")).astype(np.int64)
    for pair in (b"re", b"ve", b"ll"):
        size[(one == pair[0]) & (two == pair[1])] = 2
    mark, size = mark[size > 0], size[size > 0]
    begins[mark + 1] = False
    begins[(mark + 1 + size)[kind[mark + 1 + size] == LETTER]] = True
    at = np.flatnonzero(begins).astype(np.int32)
    offsets = np.append(at, np.int32(len(data)))
    segments = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return segments, np.searchsorted(at, starts)


class Vocabulary:
    """The parts of a tokenizer file: ids, merges, special strings, split pattern."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        model = parsed["model"]
        steps = [n["type"] for n in parsed["normalizer"]["normalizers"]]
        splits = parsed["pre_tokenizer"]["pretokenizers"]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in splits] != ["Split", "ByteLevel"]
            or model["type"] != "BPE"
            or any(model[k] for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
            or splits[0]["pattern"]["Regex"] != PATTERN
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"])
        ):
            raise ValueError(f"{path} is not a word-wise byte-pair vocabulary of the supported kind")
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.ids = model["vocab"]
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.word_end = model["end_of_word_suffix"] or ""
        self.has_decoder = parsed["decoder"] is not None
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self._token = regex.compile(splits[0]["pattern"]["Regex"])
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self._mapped = byte_letters()
        self._model = self.library.model

    def is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not (self.special and self._special.search(text))

    def tokens_of_word(self, word: str) -> list[str]:
        """The pre-tokens of a white-space separated word of a plain text; its ASCII letters stand for themselves."""
        if word.isalpha():
            found = [word.lower()]
        elif word[:-1].isalpha() and word[-1] in STOPS:
            found = [word[:-1].lower(), word[-1]]
        else:
            found = self._token.findall(word.lower())
        return [t if t.isascii() else self.mapped(t) for t in found]

    def mapped(self, token: str) -> str:
        """The letters that stand for the bytes of a pre-token."""
        return token.encode().decode("latin-1").translate(self._mapped)

    def ids_of_token(self, token: str) -> list[int]:
        """The ids of one pre-token, merged by the library."""
        return [t.id for t in self._model.tokenize(token)]

    def tokens_of_text(self, text: str) -> list[str | int]:
        """The pre-tokens of any text, with the ids of special strings in their places."""
        found, at = [], 0
        for match in self._special.finditer(text) if self.special else ():
            found += self._by_library(text[at : match.start()])
            found.append(self.special[match.group()])
            at = match.end()
        return found + self._by_library(text[at:])

    def _by_library(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        return [token for token, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256 on."""
    printing = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: b for b in printing} | {b: 256 + i for i, b in enumerate(others)}
