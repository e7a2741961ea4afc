"""Media columns: baseline JPEG, read without an image library.

The decoder parses the markers, Huffman-decodes the scans of many images at once
(every restart interval is a lane, and numpy advances all lanes by one symbol a
step), and rebuilds a luminance thumbnail from the DC coefficients alone: one
value for each 8 x 8 block. It handles sequential Huffman JPEG with 8-bit
samples, any sampling factors, one or more scans, with or without restart
markers. ``describe`` stores dimensions, component count, and a hash of the thumbnail.

The encoder is the lossless counterpart for bytes: each 64 bytes become the 64
quantised coefficients of one luminance block (in zigzag order, the byte's value
as the coefficient), entropy-coded by the standard's method with quantiser 1 and
one block for each restart interval; a comment segment tells the byte count.

Defined cases: a null text is empty, and its payload is 64 zero bytes; texts of
any length are stored whole, in rows of 1024 blocks, or more where the image would be
too high for its format (texts over 537 MB); bytes that aren't a
readable baseline JPEG give null dimensions and an ``error``; repeated rows give
equal values; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ROW = 64, 1024
#: Blocks that are coded, and restart intervals that are decoded, at once.
SLICE = 1 << 14
#: Rows of blocks that an image can have.
HIGHEST = 65535 // 8

# Huffman codes of stored payloads, as symbols in order of rising code length.
# A symbol is 16 times the run of zero coefficients before the value plus the value's bits;
# 0x00 ends a block, 0xF0 is a run of 16 zeros. The lengths suit texts: values of 7 bits are letters.
AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 3, 0x00: 4, 0x05: 5, 0x04: 6}
DC_LENGTHS = {7: 1, 6: 2, 8: 3, 0: 4, 5: 5, 4: 6, 3: 7, 2: 8, 1: 9, 9: 10, 10: 11, 11: 12}


def _stored_ac_lengths() -> dict[int, int]:
    """The lengths above, then 12 bits for the other run-free values, the rest at 14."""
    out = dict(AC_LENGTHS)
    out |= {s: 12 for s in (0x01, 0x02, 0x03, 0x09, 0x0A, 0xF0)}
    out |= {16 * run + bits: 14 for run in range(1, 16) for bits in range(1, 11)}
    return out


def _dht(lengths: dict[int, int]) -> bytes:
    """BITS and HUFFVAL of a table with those code lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17)) + bytes(symbols)


@functools.cache
def huffman(table: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Of BITS and HUFFVAL: symbol and code length for each next 16 bits (length 0: no code); symbol to (code, length)."""
    symbol, length, codes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), {}
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            if code >= 1 << n or at >= len(table):
                raise ValueError("Huffman table has too many codes")
            lo = code << (16 - n)
            symbol[lo : lo + (1 << (16 - n))], length[lo : lo + (1 << (16 - n))] = table[at], n
            codes[table[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length, codes


@dataclass
class Scan:
    """What the markers say about one scan: its components and where its data are."""

    components: list[int]
    dc: list[bytes]
    ac: list[bytes]
    restart: int
    begin: int
    end: int


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


def parse(data: bytes) -> Jpeg:
    """The markers of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out, tables, restart, at = Jpeg(), {}, 0, 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return out
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if at > len(data):
            raise ValueError("a segment is cut off")
        if marker in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.width or not out.height:
                raise ValueError("not a frame of 8-bit samples")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDB:
            while body:
                n = 129 if body[0] >> 4 else 65
                out.quantisers[body[0] & 15], body = np.frombuffer(body[1:n], ">u2" if body[0] >> 4 else "u1").astype(np.int64), body[n:]
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            tail = np.frombuffer(data, np.uint8)[at:]
            ff = np.flatnonzero(tail[:-1] == 0xFF)
            after = tail[ff + 1]
            ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]  # markers other than restarts
            if not len(ends):
                raise ValueError("no EOI marker")
            end = at + int(ends[0])
            out.scans.append(Scan([c for c, _ in chosen], [tables.get(t >> 4, b"") for _, t in chosen], [tables.get(16 + (t & 15), b"") for _, t in chosen], restart, at, end))
            at = end


def _layout(image: Jpeg, scan: Scan) -> tuple[list[int], int, int]:
    """Component of each block of an MCU; MCUs across and down."""
    hmax, vmax = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(scan.components) > 1:
        order = [c for c in scan.components for _ in range(image.components[c][1] * image.components[c][2])]
        return order, -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
    _, h, v, _ = image.components[scan.components[0]]
    return [scan.components[0]], -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan's data without stuffing and restart markers, and where each restart interval begins."""
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.sort(np.concatenate((ff[after == 0] + 1, marks, marks + 1)))
    return np.delete(data, gone), np.concatenate(([0], marks - np.searchsorted(gone, marks)))


def decode(images: list[tuple[bytes, Jpeg]], whole: bool = True) -> list[dict[int, np.ndarray]]:
    """Quantised coefficients (blocks x 64, zigzag order) by component, for each image.

    whole: all 64 coefficients; else the first (DC) alone is kept. Lanes of
    all images that share their Huffman tables and MCU layout advance together.
    """
    out: list[dict[int, np.ndarray]] = [{} for _ in images]
    groups: dict[tuple, list[tuple[int, Scan, int]]] = {}
    for i, (_, image) in enumerate(images):
        for scan in image.scans:
            order, across, down = _layout(image, scan)
            own = [scan.components.index(c) for c in order]
            groups.setdefault((tuple(order), tuple(scan.dc[k] for k in own), tuple(scan.ac[k] for k in own)), []).append((i, scan, across * down))
    for (order, dc, ac), scans in groups.items():
        _decode_group(images, out, order, dc, ac, scans, 64 if whole else 1)
    return out


def _decode_group(images, out, order, dc, ac, scans, width) -> None:
    parts, begins, units, at = [], [], [], 0
    for i, scan, mcus in scans:
        data, begin = _intervals(np.frombuffer(images[i][0], np.uint8)[scan.begin : scan.end])
        each = scan.restart or mcus
        if len(begin) != -(-mcus // each):
            raise ValueError("restart intervals are missing")
        parts += [data, np.full(8, 255, np.uint8)]
        begins.append(begin + at)
        units.append(np.minimum(each, mcus - each * np.arange(len(begin))))
        at += len(data) + 8
    whole = np.concatenate(parts)
    begin, unit, per = np.concatenate(begins), np.concatenate(units).astype(np.int64) * len(order), len(order)
    base = np.cumsum(unit) - unit  # first block of each lane
    value = np.zeros((int(unit.sum()), width), np.int16)
    luts = {}
    for table in {*dc, *ac}:
        luts[table] = huffman(table)[:2]
    table_ids = {t: n for n, t in enumerate(luts)}
    # symbol and code length of the next 16 bits in one number, table after table
    lookup = np.concatenate([(luts[t][0] << 8 | luts[t][1]).astype(np.int32) for t in luts])
    dc_of, ac_of, component = np.array([table_ids[t] for t in dc]), np.array([table_ids[t] for t in ac]), np.array(order)
    all_begin, all_unit, all_base = np.append(begin, len(whole) - 8), unit, base
    for s in range(0, len(unit), SLICE):  # what the lanes' steps need grows with the slice, not with the image
        lo, hi = int(all_begin[s]), int(all_begin[min(s + SLICE, len(all_unit))])
        begin, unit, base = all_begin[s : s + SLICE][: len(all_unit) - s] - lo, all_unit[s : s + SLICE], all_base[s : s + SLICE]
        stream = whole[lo : hi + 8].astype(np.uint32)
        word = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
        lane, limit = np.arange(len(begin)), len(word)
        pos, block, k, last = begin * 8, np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int32), np.zeros((len(begin), max(order) + 1), np.int64)
        while len(lane):
            unit_at = block % per if per > 1 else 0
            first = k == 0
            at = pos >> 3
            if at.max() >= limit:
                raise ValueError("a scan is cut off")
            bits = word[at] << (pos & 7).astype(np.uint32)
            next16 = (bits >> np.uint32(16)).astype(np.int32)
            any_first, any_later = first.any(), not first.all()
            if per > 1 or any_first and any_later:
                entry = lookup[np.where(first, dc_of[unit_at], ac_of[unit_at]) * 65536 + next16]
            else:  # all lanes use the same table
                which = int(dc_of[0] if any_first else ac_of[0]) * 65536
                entry = lookup[which : which + 65536][next16]
            symbol, length = entry >> 8, entry & 255
            if not length.all():
                raise ValueError("a scan has no such code")
            size = symbol & 15
            if int((length + size).max()) > 24:
                after = pos + length
                bits = word[after >> 3] << (after & 7).astype(np.uint32)
            else:
                bits <<= length.astype(np.uint32)
            raw = ((bits >> np.uint32(16)) >> (16 - size).astype(np.uint32)).astype(np.int32)
            pos += length + size
            number = np.where((raw << 1) >> size > 0, raw, raw - (1 << size) + 1)  # no bits: 0
            run = symbol >> 4
            where = base[lane] + block
            if any_first:
                c = component[unit_at] if per > 1 else component[0]
                f = np.flatnonzero(first)
                cf = c[f] if per > 1 else c
                last[lane[f], cf] += number[f]
                value[where[f], 0] = last[lane[f], cf]
            if any_later:
                end = (symbol == 0) & ~first
                to = np.where(first, 0, k + run)
                if width > 1:
                    set_ = np.flatnonzero(~first & (size > 0))
                    if (to[set_] > 63).any():
                        raise ValueError("a block has more than 64 coefficients")
                    value[where[set_], to[set_]] = number[set_]
                k = np.where(first, 1, np.where(end, 64, to + 1))
            else:
                k = np.ones_like(k)
            done = k >= 64
            if done.any():
                block, k = block + done, np.where(done, 0, k)
                left = block < unit[lane]
                if not left.all():
                    lane, pos, block, k = lane[left], pos[left], block[left], k[left]
    at = 0
    for i, _, mcus in scans:
        blocks = value[at : at + mcus * per].reshape(mcus, per, width)
        for c in dict.fromkeys(order):
            out[i][c] = blocks[:, [n for n, x in enumerate(order) if x == c]].reshape(-1, width)
        at += mcus * per


def thumbnail(image: Jpeg, dc: np.ndarray) -> np.ndarray:
    """Luminance (0 to 255) of each 8 x 8 block of the first component, from its DC coefficients."""
    _, h, v, q = image.components[0]
    hmax, vmax = max(c[1] for c in image.components), max(c[2] for c in image.components)
    scan = next(s for s in image.scans if 0 in s.components)
    order, across, down = _layout(image, scan)
    wide, high = (h, v) if len(scan.components) > 1 else (1, 1)
    grid = dc.reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
    rows, columns = -(-(-(-image.height * v // vmax)) // 8), -(-(-(-image.width * h // hmax)) // 8)
    quantiser = image.quantisers[q][0] if q in image.quantisers else 1
    return np.clip(grid[:rows, :columns].astype(np.int64) * quantiser // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(grid: np.ndarray) -> str:
    """16 hexadecimal digits: whether each cell of the thumbnail, sampled 8 x 9, is darker than the next one."""
    rows = np.arange(8) * grid.shape[0] // 8
    columns = np.arange(9) * grid.shape[1] // 9
    cells = grid[np.ix_(rows, columns)].astype(np.int64)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


# The lossless store


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


@functools.cache
def _codes() -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables; code with value bits, and its length, by value: for DC, for AC without a run."""
    dc, ac = _dht(DC_LENGTHS), _dht(_stored_ac_lengths())
    out = []
    for table in (dc, ac):
        codes, code, length = huffman(table)[2], np.zeros(256, np.int64), np.zeros(256, np.int64)
        for x in range(256):
            size = x.bit_length()
            if size or table is dc:
                c, n = codes[size]
                code[x], length[x] = (c << size) | x, n + size
        out += [code, length]
    return dc, ac, *out


def _entropy(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all blocks (n x 64 values 0 to 255), stuffed, and where each block's begin."""
    _, ac, dc_code, dc_length, ac_code, ac_length = _codes()
    codes = huffman(ac)[2]
    n = len(blocks)
    code, length = ac_code[blocks], ac_length[blocks]  # a zero coefficient has no code of its own
    code[:, 0], length[:, 0] = dc_code[blocks[:, 0]], dc_length[blocks[:, 0]]
    set_ = blocks != 0
    set_[:, 0] = True
    last = 63 - np.argmax(set_[:, ::-1], axis=1)
    end_code, end_length = np.where(last < 63, codes[0x00][0], 0), np.where(last < 63, codes[0x00][1], 0).astype(np.int32)
    gaps = np.flatnonzero((set_.sum(axis=1) < last + 1))
    if len(gaps):
        zeros_code, zeros_length = np.zeros((n, 64), np.int32), np.zeros((n, 64), np.int32)
    for b in gaps:  # zeros between other values: rare in texts
        previous = 0
        for k in np.flatnonzero(set_[b])[1:]:
            run, previous = int(k - previous - 1), int(k)
            if run:
                x, size = int(blocks[b, k]), int(blocks[b, k]).bit_length()
                c, m = codes[16 * (run % 16) + size]
                code[b, k], length[b, k] = (c << size) | x, m + size
                z, zn = codes[0xF0]
                for _ in range(run // 16):
                    zeros_code[b, k] = (zeros_code[b, k] << zn) | z
                    zeros_length[b, k] += zn
    # each coefficient's code, the end of block, and ones up to a whole byte
    total = length.sum(axis=1, dtype=np.int32) + end_length
    if len(gaps):
        total += zeros_length.sum(axis=1, dtype=np.int32)
    pad = -total % 8
    codes_all, lengths_all = np.empty((n, 66), np.int32), np.empty((n, 66), np.int32)
    codes_all[:, :64], codes_all[:, 64], codes_all[:, 65] = code, end_code, (1 << pad) - 1
    lengths_all[:, :64], lengths_all[:, 64], lengths_all[:, 65] = length, end_length, pad
    if len(gaps):  # the runs of 16 zeros before a coefficient
        both_codes, both_lengths = np.zeros((n, 66, 2), np.int32), np.zeros((n, 66, 2), np.int32)
        both_codes[:, :64, 0], both_codes[:, :, 1] = zeros_code, codes_all
        both_lengths[:, :64, 0], both_lengths[:, :, 1] = zeros_length, lengths_all
        codes_all, lengths_all = both_codes, both_lengths
    size = (total + pad) // 8
    m = lengths_all.ravel()
    some = np.flatnonzero(m)
    c, m = codes_all.ravel()[some], m[some]
    at = np.cumsum(m, dtype=np.int64) - m
    word = at >> 5
    shifted = c.astype(np.uint64) << (64 - (at & 31) - m).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
    words[word[first] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    data = words.astype(">u4").view(np.uint8)[: int(size.sum())]
    ff = data == 0xFF
    stuffed = np.zeros(len(data) + int(ff.sum()), np.uint8)
    before = np.cumsum(ff) - ff
    stuffed[np.arange(len(data)) + before] = data
    begin = np.cumsum(size) - size
    return stuffed, np.append(begin + before[begin], len(stuffed))


def blocks_wide(n: int) -> int:
    """Blocks in a row of an image of n blocks."""
    return max(min(n, ROW), -(-n // HIGHEST))


def _marked(data: np.ndarray, begin: np.ndarray) -> bytes:
    """Blocks' bytes, each with a restart marker behind it; the first block's number in its image is a multiple of 8."""
    n, lo = len(begin) - 1, int(begin[0])
    scan = np.zeros(int(begin[-1]) - lo + 2 * n, np.uint8)
    scan[np.arange(int(begin[-1]) - lo) + 2 * np.repeat(np.arange(n), np.diff(begin))] = data[lo : int(begin[-1])]
    marks = begin[1:] - lo + 2 * np.arange(n)
    scan[marks], scan[marks + 1] = 0xFF, 0xD0 + np.arange(n) % 8
    return scan.tobytes()


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, a positive multiple of 64 bytes long."""
    counts = [len(p) // BLOCK for p in payloads]
    padded = [-(-n // blocks_wide(n)) * blocks_wide(n) for n in counts]
    joined = b"".join(p + bytes(BLOCK * (m - n)) for p, n, m in zip(payloads, counts, padded, strict=True))
    blocks = np.frombuffer(joined, np.uint8).reshape(-1, BLOCK)
    coded, begins, size = [], [np.zeros(1, np.int64)], 0
    for s in range(0, len(blocks), SLICE):
        part, begin = _entropy(blocks[s : s + SLICE])
        coded.append(part)
        begins.append(begin[1:] + size)
        size += len(part)
    data, begin = np.concatenate(coded), np.concatenate(begins)
    dc, ac = _codes()[:2]
    tables = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64 + b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + len(t), k) + t for k, t in ((0x00, dc), (0x10, ac))) + b"\xff\xdd\x00\x04\x00\x01\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    # restart markers: two bytes after each block but an image's last
    out, at = [], 0
    for n, m in zip(counts, padded, strict=True):
        scan = b"".join(_marked(data, begin[at + s : at + min(s + SLICE, m) + 1]) for s in range(0, m, SLICE))[:-2]
        wide = blocks_wide(n)
        comment = b"bytes=%d" % (n * BLOCK)
        frame = struct.pack(">HBHHBBBB", 11, 8, 8 * (m // wide), 8 * wide, 1, 1, 0x11, 0)
        out.append(b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(comment)) + comment + b"\xff\xc0" + frame + tables + scan + b"\xff\xd9")
        at += m
    return out


def load(files: list[bytes]) -> list[tuple[bytes, str]]:
    """The payload of each stored JPEG, and its feature: dimensions and thumbnail hash."""
    images = [(f, parse(f)) for f in files]
    out = []
    for (_, image), coefficients in zip(images, decode(images), strict=True):
        payload = coefficients[0].astype(np.uint8).tobytes()[: int(image.comment.removeprefix(b"bytes="))]
        out.append((payload, f"{image.width}x{image.height}:{thumbnail_hash(thumbnail(image, coefficients[0][:, 0]))}"))
    return out


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batched(items: list, size, most: int) -> Iterator[list]:
    """Runs of items of about ``most`` bytes together; a larger item is alone."""
    run, total = [], 0
    for x in items:
        if run and total + size(x) > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += size(x)
    if run:
        yield run


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a JPEG, reads that back, and returns key and the columns of MEDIA."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for run in _batched([payload_of(t) for t in batch["text"]], len, 1 << 20):
                files = store(run)
                rows += [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), x) for f, (p, x) in zip(files, load(files), strict=True)]
            media = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            media.insert(0, "n_bytes", [len((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]])
            media.insert(0, "key", batch["key"].to_numpy())
            yield media

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(work, f"key {kind}, {MEDIA}").withColumnRenamed("key", key)


def describe(media: DataFrame, key: str, data: str) -> DataFrame:
    """key, width, height, n_components, thumbnail_hash, error of each JPEG in a binary column."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None, None, "no data"
        try:
            image = parse(bytes(raw))
            dc = decode([(bytes(raw), image)], whole=False)[0][0][:, 0]
            return image.width, image.height, len(image.components), thumbnail_hash(thumbnail(image, dc)), None
        except (ValueError, IndexError, KeyError, struct.error, StopIteration) as e:
            return None, None, None, None, f"{type(e).__name__}: {e}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(x) for x in batch["data"]], columns=["width", "height", "n_components", "thumbnail_hash", "error"])
            out.insert(0, "key", batch["key"].to_numpy())
            yield out.astype({c: "Int64" for c in ("width", "height", "n_components")})

    rows = media.select(F.col(key).alias("key"), F.col(data).alias("data"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(work, f"key {kind}, width long, height long, n_components long, thumbnail_hash string, error string").withColumnRenamed("key", key)
