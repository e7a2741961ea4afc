"""Public tokenizers in tasks: byte-level BPE and SentencePiece pieces, a chunk of text at a time.

A chunk begins at a space that follows anything but white space and goes up to the
next such space. No token of either tokenizer goes over that border (``Pieces``
checks its vocabulary for it), so a text's tokens are those of its chunks, and a
chunk that was met needs no second look.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Fixed value: the byte-level BPE's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer run of letters takes the faster of the two BPE libraries quadratic time; the other one gives the same ids.
LONG = 512

_BORDER = re.compile(r"(?<=\S)(?= )")
_MIXED = re.compile(r"\s ")
_BLANK = re.compile(r"\s{%d}" % LONG)


def chunks(text: str) -> list[str]:
    """The chunks of a space and the text, each without its first space."""
    if text[:1] != " " and not _MIXED.search(text):
        return text.split(" ")
    return [c[1:] for c in _BORDER.split(" " + text)]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _short_runs(text: str) -> bool:
    return len(text) <= LONG or (max(map(len, text.split()), default=0) <= LONG and not _BLANK.search(text))


class ByteBPE:
    """Byte-level BPE from a tokenizer's JSON. Strings of special tokens are plain text, but for ``with_special``."""

    def __init__(self, source: str):
        import tiktoken
        import tokenizers

        spec, of = json.loads(source), _byte_of()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes[i] = token
        self.library, self.with_special_tokens = tokenizers.Tokenizer.from_str(source), tokenizers.Tokenizer.from_str(source)
        self.library.encode_special_tokens = True
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if _short_runs(text) else self.library.encode(text, add_special_tokens=False).ids

    def with_special(self, text: str) -> list[int]:
        """The ids where the text may hold special tokens' strings, which stand for those tokens."""
        return self.with_special_tokens.encode(text, add_special_tokens=False).ids


class Pieces:
    """SentencePiece pieces of a model that puts a space before each text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.alone = p.piece_to_id(SPACE)
        if any(re.search(r"\S ", n.replace(SPACE, " ")) for n in names):
            raise ValueError("a piece goes over a chunk's border")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the library has no pieces for an empty text, where a lone space at a text's end is one
        return [x or [self.alone] for x in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def byte_bpe(source: str) -> ByteBPE:
    return ByteBPE(source)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_bpe(path: str) -> str:
    """A tokenizer's JSON, read on the driver: a fixed vocabulary of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Chunks:
    """Chunks that were met, numbered as they come; subclasses keep what they compute for each in arrays of their own.

    Over ``most`` chunks, or after a very long one, all are forgotten before the next
    batch, and the common ones soon come back: memory is bounded whatever the texts.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.stale = False

    def learn(self, runs: list[str], alone: list[str]) -> None:
        """Appends what is known of new chunks: first those of ``runs``, many to a text, which encodes to their tokens
        one after another; then those that stand alone, as they are long, empty or end in white space."""
        raise NotImplementedError

    def of(self, texts: list[str], at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of the texts, and how many each text has."""
        if self.stale or len(self.number) > self.most:
            self.clear()
        split = [chunks(t) for t in texts]
        keys = [k for s in split for k in s]
        found = list(map(self.number.get, keys))
        if None in found:
            new = dict.fromkeys([k for k, n in zip(keys, found, strict=True) if n is None])
            plain = [k for k in new if k and len(k) <= LONG and not k[-1].isspace()]
            alone = [k for k in new if not k or len(k) > LONG or k[-1].isspace()]
            first = len(self.number)
            self.learn([" ".join(plain[i : i + at_once]) for i in range(0, len(plain), at_once)], alone)
            for i, k in enumerate([*plain, *alone], first):
                self.number[k] = i
            found = list(map(self.number.__getitem__, keys))
            self.stale = max(map(len, alone), default=0) > 64 * LONG
        return np.fromiter(found, np.int64, len(found)), np.array([len(s) for s in split], np.int64)


class Pool:
    """A growing array of stretches, one for each chunk."""

    def __init__(self, kind):
        self.values, self.first, self.n = np.empty(1 << 16, kind), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.held = self.size = 0

    def add(self, values: np.ndarray, n: np.ndarray) -> None:
        """Appends stretches of n[0], n[1], ... values."""
        while self.held + len(values) > len(self.values):
            self.values = np.concatenate((self.values, np.empty_like(self.values)))
        while self.size + len(n) > len(self.n):
            self.first, self.n = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.n))
        self.values[self.held : self.held + len(values)] = values
        self.first[self.size : self.size + len(n)] = self.held + np.cumsum(n) - n
        self.n[self.size : self.size + len(n)] = n
        self.held += len(values)
        self.size += len(n)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of the numbered chunks, one after another, and how long each is."""
        n = self.n[numbers]
        return self.values[taken(self.first[numbers], n)], n


def taken(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places first[0], first[0] + 1, ..., n[0] of them, then those from first[1] on, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of stretches of n[0], n[1], ... values."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    stop = np.cumsum(n)
    return total[stop] - total[stop - n]
