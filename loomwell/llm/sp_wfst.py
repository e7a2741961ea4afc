"""SentencePiece encoding and decoding as shortest paths through a transducer.

A model file is compiled into the parts of one weighted transducer: the
normaliser (its character map, which rewrites the longest source at each place and
leaves user-defined symbols alone, then white space rules, dummy prefix and spaces
as U+2581), the pieces, and byte fallback for single characters. Composed with an
input, it is a lattice whose arcs are the pieces between two places of the text; the
encoding is the lattice's shortest path in the tropical semiring (weights add along a
path, the least path wins).

* A unigram model weighs an arc by its piece's negative score.
* A BPE model has no weights for pieces alone: it weighs pairs. A piece may
  follow another (weight 0, else infinite) if merging their joined text gives
  back the two. A sequence all of whose neighbours pass is the encoding, and no
  other sequence passes: the first merge of the text that crosses a piece's
  border would cross it between these two alone as well. The pair arcs are
  compiled when first met and kept. User-defined symbols are forced arcs: the
  lattice has no other way across them.

Where no piece of several characters can lie across two neighbouring characters,
all paths meet, and the text is cut there: the path is the sum of the parts'
paths. Parts are kept with their paths in a memory of at most about 250 MB in each Python worker.

Defined cases: a null or empty text has no pieces and decodes to the empty text;
texts of any length are encoded whole; U+2581 in a text stands for a space, as
the format has it; a model whose normaliser rewrites texts gives back the rewritten
text, so ``round_trip`` is false where it changed something; repeated rows give equal results; an empty table gives an
empty result; other columns of the table are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
INFINITE = float("inf")


def character_map(blob: bytes) -> dict[str, str]:
    """Sources and targets of a normaliser's compiled character map.

    The blob is the length of a double-array trie over UTF-8 bytes, the trie, and the
    targets, each ended by a zero byte. The trie is walked level by level.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    out, places, keys, byte = {}, offset[:1].copy(), [b""], np.arange(1, 256)
    while len(places):
        child = places[:, None] ^ byte[None, :]
        inside = child < len(units)
        label = units[np.where(inside, child, 0)] & ((1 << 31) | 0xFF)
        row, column = np.nonzero(inside & (label == byte[None, :]))
        at = child[row, column]
        places, keys = at ^ offset[at], [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), column.tolist(), strict=True)]
        for i in np.flatnonzero((units[at] >> 8) & 1).tolist():
            begin = int(units[places[i]] & 0x7FFFFFFF)
            out[keys[i].decode()] = targets[begin : targets.index(b"\0", begin)].decode()
    return out


class Normaliser:
    """The transducer before the pieces: character map, white space, dummy prefix, spaces as U+2581."""

    def __init__(self, spec, symbols: list[str], suffix: bool):
        self.map = character_map(spec.precompiled_charsmap)
        self.longest: dict[str, int] = {}
        for source in self.map:
            self.longest[source[0]] = max(len(source), self.longest.get(source[0], 0))
        self.first = re.compile("[" + "".join(map(re.escape, sorted(self.longest))) + "]") if self.map else None
        self.symbols = re.compile("(" + "|".join(map(re.escape, sorted(symbols, key=len, reverse=True))) + ")") if symbols else None
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def rewritten(self, text: str) -> str:
        """The character map applied, longest source first."""
        out, at = [], 0
        for m in self.first.finditer(text):
            i = m.start()
            if i < at:
                continue
            for n in range(self.longest[text[i]], 0, -1):
                to = self.map.get(text[i : i + n])
                if to is not None:
                    out += (text[at:i], to)
                    at = i + len(text[i : i + n])
                    break
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        given = bool(text)
        if self.map:
            text = "".join(x if i % 2 else self.rewritten(x) for i, x in enumerate(self.symbols.split(text))) if self.symbols else self.rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            given = bool(text)
        if given and self.dummy:
            text = text + " " if self.suffix else " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Transducer:
    """A compiled model. ``remember`` bounds the bytes of parts that are kept with their paths."""

    def __init__(self, model: bytes, remember: int = 100_000_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        symbols = [p.piece for p in proto.pieces if p.type == USER]
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.normalise = Normaliser(proto.normalizer_spec, symbols, self.suffix)
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.unigram = proto.trainer_spec.model_type == 1
        self.surface = [p.piece for p in proto.pieces]
        # symbols: arcs of the lattice with the format's bonus, or, without piece weights, forced ones
        self.forced = {} if self.unigram else {p.piece: i for i, p in enumerate(proto.pieces) if p.type == USER}
        self.arcs = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED) or p.type == USER and self.unigram}
        top = max((p.score for p in proto.pieces if p.type == NORMAL), default=0.0)
        self.score = [len(p.piece) * top - 0.1 if p.type == USER else p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_weight = 10.0 - min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.output = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.output[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.byte_ids = frozenset(self.bytes.values())
        self.remember, self.held, self.paths, self.older, self.pairs = remember, 0, {}, {}, {}
        self._build()
        self.parts = re.compile(self._cut_pattern())

    def _cut_pattern(self) -> str:
        """Finds the longest stretches that pieces of several characters can lie across."""
        inner: set[str] = set()
        after_text = False
        for p in self.arcs:
            if len(p) > 1:
                inner.update(p)
                after_text |= SPACE in p.lstrip(SPACE)
        inner.discard(SPACE)
        text = "".join(map(re.escape, sorted(inner)))
        if not text:
            return "(?s)."
        return f"(?s)[{SPACE}{text}]+|." if after_text else f"(?s){SPACE}*[{text}]+|{SPACE}+|."

    def _build(self) -> None:
        """The automaton of the pieces: its state after a character is the longest end of the text that begins a piece.

        ``ends`` has, for each state, the pieces that end there, longest first.
        """
        self.moves: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for piece, i in self.arcs.items():
            state = 0
            for c in piece:
                after = self.moves[state].get(c)
                if after is None:
                    after = self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    own.append(-1)
                state = after
            own[state] = i
        self.shorter, self.ends = [0] * len(self.moves), [()] * len(self.moves)
        level = [(0, c, s) for c, s in self.moves[0].items()]
        while level:
            further = []
            for above, c, state in level:
                fallback = self.shorter[above]
                while above and fallback and c not in self.moves[fallback]:
                    fallback = self.shorter[fallback]
                self.shorter[state] = self.moves[fallback].get(c, 0) if above else 0
                mine = ((own[state], len(self.surface[own[state]])),) if own[state] >= 0 else ()
                self.ends[state] = mine + self.ends[self.shorter[state]]
                further += [(state, x, s) for x, s in self.moves[state].items()]
            level = further

    def _move(self, state: int, c: str) -> int:
        """The state after ``c`` where the trie has no such step; kept for states below the root."""
        at = state
        while at and c not in self.moves[at]:
            at = self.shorter[at]
        after = self.moves[at].get(c, 0)
        if state and after:
            self.moves[state][c] = after
        return after

    def _merged(self, text: str) -> list[str]:
        """A BPE model's merges on a short text: the best-scored adjacent pair first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = -INFINITE, -1
            for i in range(len(symbols) - 1):
                piece = self.arcs.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.score[piece] > best:
                    best, at = self.score[piece], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def weight(self, before: int, piece: int) -> float:
        """Of an arc with ``piece`` behind one with ``before`` (-1 at the start)."""
        if self.unigram:
            return -self.score[piece] if piece < len(self.score) else self.unknown_weight
        parts = [self.label(i) for i in (before, piece) if i >= 0]
        w = 0.0 if self._merged("".join(parts)) == parts else INFINITE
        if len(self.pairs) >= 600_000:
            self.pairs.clear()
        self.pairs[before << 32 | piece] = w
        return w

    def label(self, arc: int) -> str:
        """An arc's text; arcs beyond the pieces are single characters that byte fallback writes."""
        return self.surface[arc] if arc < len(self.surface) else chr(arc - len(self.surface))

    def shortest(self, part: str) -> list[int]:
        """The arcs on the least path through the lattice of a part.

        A place keeps its best arc only. That is all a unigram model needs; in a
        BPE model one piece alone can end at a place on a finite path, since the
        encoding of a text's beginning is unique.
        """
        n, fixed, pairs, unigram = len(part), len(self.surface), self.pairs, self.unigram
        total, back, last = [0.0] + [INFINITE] * n, [0] * (n + 1), [-1] * (n + 1)
        moves, ends, state = self.moves, self.ends, 0
        for end in range(1, n + 1):
            c = part[end - 1]
            state = moves[state].get(c) or self._move(state, c)
            found = ends[state]
            if not found or found[-1][1] > 1:  # a character that is no piece: byte fallback
                found = (*found, (fixed + ord(c), 1))
            for arc, length in found:
                begin = end - length
                before = last[begin]
                w = None if unigram else pairs.get(before << 32 | arc)
                if w is None:
                    w = self.weight(before, arc)
                w += total[begin]
                if w < total[end]:
                    total[end], back[end], last[end] = w, begin, arc
                    if not unigram:
                        break
        path = []
        while n:
            path.append(last[n])
            n = back[n]
        return path[::-1]

    def ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for arc in self.shortest(part):
            if arc < len(self.surface):
                out.append(arc)
            elif self.bytes:
                out += [self.bytes[b] for b in self.label(arc).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        whole = self.normalise(text)
        if not self.forced:
            return self._encoded(whole, out)
        for i, part in enumerate(self.normalise.symbols.split(whole)):
            if i % 2:
                out.append(self.forced[part])
            else:
                self._encoded(part, out)
        return out

    def _encoded(self, text: str, out: list[int]) -> list[int]:
        paths, extend, merge, unknown = self.paths, out.extend, not self.bytes, self.unknown
        for part in self.parts.findall(text):
            ids = paths.get(part)
            if ids is None:
                ids = self.older.get(part) or self.ids(part)
                if len(part) <= 64:
                    if self.held >= self.remember:  # parts met since the last turn stay for another
                        self.older, self.held = paths, 0
                        self.paths = paths = {}
                    paths[part] = ids
                    self.held += 250 + 12 * len(part)  # about what the entry takes
            if merge and out and out[-1] == ids[0] == unknown:  # a run of unknown characters is one
                ids = ids[1:]
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        output = self.output
        text = b"".join([output[i] for i in ids]).decode("utf-8", "replace")
        if not self.dummy_prefix:
            return text
        return text.removesuffix(" ") if self.suffix else text.removeprefix(" ")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": 0, "paths": {}, "older": {}, "pairs": {}}


def compiled(df: DataFrame, model: str = MODEL, remember: int = 100_000_000):
    """The model as a broadcast: a fixed vocabulary, a few MB. The path is read on the driver. Each worker remembers parts
    of ``remember`` bytes, and as many of before."""
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(Transducer(f.read(), remember))


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", at_once: int = 256, remember: int = 100_000_000) -> DataFrame:
    """key, ids, n_tokens, n_byte_tokens, round_trip for each row: the pieces, and whether decoding them gives the text."""
    shared = compiled(docs, model, remember)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                offsets, values, n_bytes, same = [0], [], [], []
                for text_ in batch.column(1).to_pylist():
                    ids = t.encode(text_)
                    values.append(pa.array(ids, pa.int32()))
                    offsets.append(offsets[-1] + len(ids))
                    n_bytes.append(sum(map(t.byte_ids.__contains__, ids)))
                    same.append(t.decode(ids) == (text_ or "").replace(SPACE, " "))
                arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(values))
                lengths = pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays, lengths, pa.array(n_bytes, pa.int64()), pa.array(same)], ["key", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(work, f"key {kind}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")
    return out.withColumnRenamed("key", key)


def decode(tokens: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text for each row of ids. A null list, like an empty one, is the empty text; so is a null id in a list."""
    shared = compiled(tokens, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            texts = [t.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = tokens.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, text string").withColumnRenamed("key", key)
