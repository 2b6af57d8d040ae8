"""Sequential JPEG frames and AVI containers, vectorised over frames.

A written frame is a grey baseline JPEG of SIDE x SIDE pixels. Its unit is the quantised DCT
coefficient: with all quantisers 1, payload byte b is coefficient b - 128 in zigzag order, so frames
keep payloads without loss and any JPEG reader opens them. Tables stand in the first frame of a file;
the others are abbreviated.

What is read is wider: 8-bit sequential frames of any size and sampling, with their own quantisers,
tables and restart intervals, the standard tables where a file has none, and AVI files whose index
counts from the file's or the list's start, or is missing.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

SIDE = 24
BLOCKS = (SIDE // 8) ** 2
UNITS = BLOCKS * 64
FPS = 24


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: Inverse DCT matrix: pixel row x from frequency u.
_IDCT = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[None, :]


class Table:
    """A Huffman table: symbols by code length, as a DHT segment lists them."""

    def __init__(self, by_length: list[list[int]]):
        self.by_length = by_length
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        #: For the next 16 bits: symbol and code length; length 0 marks what is no code.
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = 0
        for n, symbols in enumerate(by_length, 1):
            for s in symbols:
                self.code[s], self.size[s] = code, n
                low, high = code << (16 - n), (code + 1) << (16 - n)
                self.symbol[low:high], self.length[low:high] = s, n
                code += 1
            code <<= 1

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *map(len, self.by_length)]) + bytes(s for x in self.by_length for s in x)
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@lru_cache(maxsize=64)
def table_of(body: bytes) -> Table:
    """The table that a DHT segment's 16 counts and its symbols describe."""
    places = np.cumsum([0, *body[:16]]) + 16
    if places[-1] != len(body):
        raise ValueError("a Huffman table is cut short")
    return Table([list(body[places[i] : places[i + 1]]) for i in range(16)])


# The typical tables of ITU-T T.81, K.3 to K.6, which motion-JPEG files may leave out.
_DC_SYMBOLS = "000102030405060708090a0b"
_STANDARD = {
    0x00: "00010501010101010100000000000000" + _DC_SYMBOLS,
    0x01: "00030101010101010101010000000000" + _DC_SYMBOLS,
    0x10: "0002010303020403050504040000017d"
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a53545556575859"
    "5a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3"
    "e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    0x11: "00020102040403040705040400010277"
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758"
    "595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2"
    "e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}


def standard_tables() -> dict[int, Table]:
    """The typical tables, by class and number."""
    return {key: table_of(bytes.fromhex(text)) for key, text in _STANDARD.items()}


def _own_tables() -> tuple[Table, Table]:
    """DC: sizes 0 to 11 in four bits. AC: single coefficients and end of block in four bits, a run of 16 zeros in six, the rest in ten."""
    dc = [[] for _ in range(16)]
    dc[3] = list(range(12))
    ac = [[] for _ in range(16)]
    ac[3] = [*range(1, 11), 0x00]
    ac[5] = [0xF0]
    ac[9] = [run << 4 | size for run in range(1, 16) for size in range(1, 11)]
    return Table(dc), Table(ac)


DC, AC = _own_tables()


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of a coefficient's magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A coefficient's magnitude bits: itself, or its ones' complement if negative."""
    return np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


def encode_scans(units: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames, from an array (frames, BLOCKS, 64) of coefficients in zigzag order."""
    frames = len(units)
    if not frames:
        return []
    v = units.astype(np.int64)
    dc = v[:, :, 0].copy()
    dc[:, 1:] -= v[:, :-1, 0]
    flat = v.reshape(-1, 64)
    flat_ac = flat[:, 1:]
    row, col = np.nonzero(flat_ac)
    ac = flat_ac[row, col]
    last = np.full(len(row), -1)
    same = row[1:] == row[:-1]
    last[1:][same] = col[:-1][same]
    run = col - last - 1
    size = _sizes(ac)
    ends = np.full(len(flat), -1)
    ends[row] = col  # the last one of a row wins: positions are in order
    # Every event: its block, its order in the block, code and extra bits.
    zrl = run // 16
    rep = np.repeat(np.arange(len(row)), zrl)
    eob = np.flatnonzero(ends < 62)
    d = dc.reshape(-1)
    dsize = _sizes(d)
    code = np.concatenate([DC.code[dsize] << dsize.astype(np.uint64) | _extra(d, dsize), np.full(len(rep), AC.code[0xF0]), AC.code[(run % 16) << 4 | size] << size.astype(np.uint64) | _extra(ac, size), np.full(len(eob), AC.code[0])])
    bits = np.concatenate([DC.size[dsize] + dsize, np.full(len(rep), AC.size[0xF0]), AC.size[(run % 16) << 4 | size] + size, np.full(len(eob), AC.size[0])])
    block = np.concatenate([np.arange(len(flat)), row[rep], row, eob])
    place = np.concatenate([np.zeros(len(flat), np.int64), col[rep] * 2 + 2, col * 2 + 3, np.full(len(eob), 200)])
    order = np.argsort(block * 256 + place, kind="stable")
    code, bits, block = code[order], bits[order], block[order]
    total = np.concatenate([[0], np.cumsum(bits)])
    first = np.searchsorted(block, np.arange(frames + 1) * BLOCKS)
    used = np.diff(total[first])
    start = np.concatenate([[0], np.cumsum((used + 7) // 8)])
    # Each frame ends on a whole byte, filled with ones.
    fill = -used % 8
    at = total[:-1] + np.repeat(start[:-1] * 8 - total[first[:-1]], np.diff(first))
    at = np.concatenate([at, start[:-1] * 8 + used])
    code = np.concatenate([code, ((1 << fill) - 1).astype(np.uint64)])
    bits = np.concatenate([bits, fill])
    value = np.where(bits > 0, code << (64 - bits - (at & 31)).clip(0, 63).astype(np.uint64), 0).astype(np.uint64)
    word, n = at >> 5, int(start[-1] // 4 + 3)
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    raw = np.frombuffer(out.astype(np.uint32).astype(">u4").tobytes(), np.uint8)[: start[-1]]
    # A data byte FF is followed by 00.
    full = np.flatnonzero(raw == 255)
    stuffed = np.insert(raw, full + 1, 0).tobytes()
    edge = start + np.searchsorted(full, start)
    return [stuffed[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def decode_scans(scans: list[bytes], layout: list[tuple[int, Table, Table]] | None = None, blocks: list[int] | None = None) -> np.ndarray:
    """Coefficients (scans, most blocks, 64) of entropy-coded runs that share a layout: all runs advance together, one symbol at a time.

    `layout` has the component and the two tables of each block of a unit (MCU), over and over;
    `blocks` the number of blocks of each run. A run starts with no DC value before it, as a scan
    does and what follows a restart marker.
    """
    layout = layout or [(0, DC, AC)]
    many = np.full(len(scans), BLOCKS) if blocks is None else np.array(blocks, np.int64)
    most = int(many.max(initial=0))
    out = np.zeros((len(scans), most * 64), np.int16)
    if not len(scans) or not most:
        return out.reshape(len(scans), most, 64)
    joined = np.frombuffer(b"".join(scans), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(s) for s in scans])])
    stuffing = np.zeros(len(joined), bool)
    stuffing[1:] = (joined[1:] == 0) & (joined[:-1] == 255)
    stuffing[edge[:-1][np.diff(edge) > 0]] = False
    edge = edge - np.concatenate([[0], np.cumsum(stuffing)])[edge]
    raw = np.concatenate([joined[~stuffing], np.full(8, 255, np.uint8)]).astype(np.uint32)
    peek = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    tables = list({id(t): t for _, *two in layout for t in two}.values())
    symbols, lengths = np.concatenate([t.symbol for t in tables]), np.concatenate([t.length for t in tables])
    number = {id(t): k for k, t in enumerate(tables)}
    period, parts = len(layout), 1 + max(c for c, _, _ in layout)
    part = np.array([c for c, _, _ in layout])
    dc_at, ac_at = np.array([number[id(d)] << 16 for _, d, _ in layout]), np.array([number[id(a)] << 16 for _, _, a in layout])
    lane = np.flatnonzero(many > 0)
    pos, k, block, last = edge[:-1][lane] * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.zeros((len(lane), parts), np.int64)
    many = many[lane]
    end = len(peek) * 8
    while len(lane):
        if int(pos.max()) >= end:
            raise ValueError("a frame is cut short")
        high = (peek[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32) & 0xFFFF).astype(np.int64)
        turn = block % period if period > 1 else np.zeros(len(lane), np.int64)
        first = k == 0
        entry = high + np.where(first, dc_at[turn], ac_at[turn])
        symbol, n = symbols[entry], lengths[entry]
        if (n == 0).any():
            raise ValueError("no such Huffman code")
        pos = pos + n
        size, run = symbol & 15, symbol >> 4
        bits = peek[np.minimum(pos >> 3, len(peek) - 1)].astype(np.int64) << (pos & 7) & 0xFFFFFFFF
        value = bits >> (32 - size)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        value[size == 0] = 0
        pos = pos + size
        head = np.flatnonzero(first)
        if len(head):
            last[head, part[turn[head]]] += value[head]
            value[head] = last[head, part[turn[head]]]
        eob = ~first & (symbol == 0)
        k = np.where(first, 0, k + run)
        put = np.flatnonzero(~eob & (k < 64))
        out[lane[put], block[put] * 64 + k[put]] = value[put]
        k = np.where(eob, 64, k + 1)
        done = k >= 64
        block = block + done
        k[done] = 0
        if done.any():
            going = block < many
            if not going.all():
                lane, pos, k, block, last, many = lane[going], pos[going], k[going], block[going], last[going], many[going]
    return out.reshape(len(scans), most, 64)


def pixels(units: np.ndarray, quantisers: np.ndarray | None = None) -> np.ndarray:
    """Pixels (frames, blocks, 8, 8) of coefficients in zigzag order; quantisers are 1 unless given."""
    plain = np.empty(units.shape, np.float32)
    plain[:, :, ZIGZAG] = units if quantisers is None else units * quantisers.astype(np.float32)
    m = _IDCT.astype(np.float32)
    grid = m @ plain.reshape(*units.shape[:2], 8, 8) @ m.T
    return np.clip(np.rint(grid + 128), 0, 255).astype(np.uint8)


_SOF = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
_SOS = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x00\x3f\x00"
_TABLES = b"\xff\xdb" + struct.pack(">H", 67) + b"\x00" + b"\x01" * 64 + DC.segment(0x00) + AC.segment(0x10)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(scans: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames with an index."""
    frames = [b"\xff\xd8" + (b"" if i else _TABLES) + _SOF + _SOS + s + b"\xff\xd9" for i, s in enumerate(scans)]
    largest = max(map(len, frames), default=0)
    header = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), largest, 10_000, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = b"LIST" + _sized(b"hdrl" + _chunk(b"avih", header) + b"LIST" + _sized(b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + b"LIST" + _sized(b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + _sized(body)


def _sized(body: bytes) -> bytes:
    return struct.pack("<I", len(body)) + body


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The frames of an AVI file's first video stream, and frames a second.

    Frames are those that the index names, by offsets from the list's or the file's start; without an
    index, the list's own chunks in their order. An empty frame repeats the one before. Chunks in other
    places are skipped.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, lists, index, stream, streams = float(FPS), [], b"", None, 0
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while todo:
        at, end = todo.pop(0)
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    lists.append((at + 8, min(end, at + 8 + size)))
                else:
                    todo.append((at + 12, min(end, at + 8 + size)))
            elif name == b"strh":
                if media[at + 8 : at + 12] == b"vids" and stream is None:
                    scale, per = struct.unpack_from("<II", media, at + 28)
                    rate, stream = per / scale if scale and per else rate, b"%02d" % streams
                streams += 1
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    wanted = {(stream or b"00") + kind for kind in (b"dc", b"db")}
    frames: list[bytes] = []

    def take(at: int, size: int) -> None:
        if size:
            frames.append(media[at + 8 : at + 8 + size])
        elif frames:
            frames.append(frames[-1])

    entries = [(index[k : k + 4], *struct.unpack_from("<II", index, k + 8)) for k in range(0, len(index) - 15, 16)]
    entries = [e for e in entries if e[0] in wanted]
    if entries and lists:
        name, at, _ = entries[0]
        base = lists[0][0] if media[lists[0][0] + at : lists[0][0] + at + 4] == name else 0
        if media[base + at : base + at + 4] != name:
            raise ValueError("the index names no frame")
        for _, at, size in entries:
            take(base + at, size)
        return frames, rate
    for low, end in lists:
        todo = [(low + 4, end)]
        while todo:
            at, end = todo.pop()
            while at + 8 <= end:
                name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
                if name == b"LIST":  # a group of records: its chunks come before what follows it
                    todo.append((at + 8 + size + (size & 1), end))
                    at, end = at + 12, at + 8 + size
                    continue
                if name in wanted:
                    take(at, size)
                at += 8 + size + (size & 1)
    return frames, rate


@dataclass(frozen=True)
class Scan:
    """Entropy-coded data of some components: runs between restart markers, and what each block of a unit is."""

    parts: tuple[tuple[int, Table, Table], ...]
    runs: tuple[bytes, ...]


@dataclass(frozen=True)
class Frame:
    """A frame's geometry, quantisers (zigzag order) by component, and scans."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quantisers: tuple[bytes, ...]
    restart: int
    scans: tuple[Scan, ...]

    @property
    def key(self) -> tuple:
        """Frames with equal keys decode together."""
        return self.width, self.height, self.sampling, self.quantisers, self.restart, tuple(tuple((c, id(d), id(a)) for c, d, a in s.parts) for s in self.scans)

    @property
    def is_payload(self) -> bool:
        """Whether this is a frame of the kind that is written here."""
        return (self.width, self.height, self.sampling, self.restart) == (SIDE, SIDE, ((1, 1),), 0) and self.quantisers == (_ONES,)

    def size_of(self, part: int) -> tuple[int, int]:
        """Width and height of a component in samples."""
        h, v = self.sampling[part]
        most_h, most_v = (max(x) for x in zip(*self.sampling, strict=True))
        return -(-self.width * h // most_h), -(-self.height * v // most_v)

    def places(self, scan: Scan) -> dict[int, np.ndarray]:
        """For each component of a scan: the positions of its blocks in the scan, as rows of blocks, edges of whole units included."""
        if len(scan.parts) == 1:  # not interleaved: the component's own blocks, row by row
            part = scan.parts[0][0]
            w, h = self.size_of(part)
            across, down = -(-w // 8), -(-h // 8)
            return {part: np.arange(across * down).reshape(down, across)}
        most_h, most_v = (max(x) for x in zip(*self.sampling, strict=True))
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        unit = sum(self.sampling[c][0] * self.sampling[c][1] for c, _, _ in scan.parts)
        first, out = 0, {}
        for c, _, _ in scan.parts:
            h, v = self.sampling[c]
            inside = first + np.arange(h * v).reshape(v, h)
            grid = np.arange(across * down).reshape(down, across) * unit
            out[c] = (grid[:, None, :, None] + inside[None, :, None, :]).reshape(down * v, across * h)
            first += h * v
        return out


_ONES = struct.pack(">64H", *[1] * 64)


@dataclass
class Tables:
    """Tables that hold until they are given anew: later frames of a file may leave theirs out."""

    huffman: dict[int, Table] = field(default_factory=standard_tables)
    quantisers: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0


def parse_frame(frame: bytes, tables: Tables) -> Frame:
    """A frame's parts; its tables go into `tables`. Progressive, lossless and arithmetic frames and samples of 12 bits are refused."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, size, sampling, kinds, ids, scans = 2, (0, 0), (), [], [], []
    tables.restart = 0
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = frame[at + 1]
        if kind == 0xFF:  # filling
            at += 1
            continue
        if kind == 0xD9:
            break
        body = frame[at + 4 : at + 2 + struct.unpack_from(">H", frame, at + 2)[0]]
        at += 4 + len(body)
        if kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables.huffman[body[0]] = table_of(body[1:n])
                body = body[n:]
        elif kind == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 1 + 64 * (1 + wide)
                tables.quantisers[number] = struct.pack(">64H", *struct.unpack(">64H" if wide else ">64B", body[1:n]))
                body = body[n:]
        elif kind == 0xDD:
            tables.restart = struct.unpack(">H", body)[0]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only samples of 8 bits")
            height, width, n = struct.unpack_from(">HHB", body, 1)
            ids = [body[6 + 3 * k] for k in range(n)]
            size, sampling = (width, height), tuple((body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n))
            kinds = [body[8 + 3 * k] for k in range(n)]
            if n == 1:  # one component is never interleaved, whatever its sampling says
                sampling = ((1, 1),)
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only sequential Huffman frames")
        elif kind == 0xDA:
            parts = []
            for k in range(body[0]):
                c, two = ids.index(body[1 + 2 * k]), body[2 + 2 * k]
                parts.append((c, tables.huffman[two >> 4], tables.huffman[0x10 | two & 15]))
            end, runs = at, []
            while True:
                stop = frame.find(b"\xff", end)
                if stop < 0 or stop + 1 >= len(frame):
                    stop = len(frame)
                    break
                if 0xD0 <= frame[stop + 1] <= 0xD7:
                    runs.append(frame[at:stop])
                    at = end = stop + 2
                elif frame[stop + 1] in (0, 0xFF):
                    end = stop + (2 if frame[stop + 1] == 0 else 1)
                else:
                    break
            runs.append(frame[at:stop])
            at = stop
            scans.append(Scan(tuple(parts), tuple(runs)))
    if not sampling or not scans:
        raise ValueError("a frame without a picture")
    return Frame(*size, sampling, tuple(tables.quantisers[k] for k in kinds), tables.restart, tuple(scans))


def decode_frames(frames: list[Frame]) -> dict[int, np.ndarray]:
    """Coefficients (frames, rows, columns of blocks, 64) of each component of frames with equal keys, zigzag order."""
    lead, out = frames[0], {}
    for number, scan in enumerate(lead.scans):
        places = lead.places(scan)
        total = sum(p.size for p in places.values())
        layout = [(c, d, a) for c, d, a in scan.parts for _ in range(lead.sampling[c][0] * lead.sampling[c][1] if len(scan.parts) > 1 else 1)]
        step = lead.restart * len(layout) or total
        count = -(-total // step)
        runs = [r for f in frames for r in (*f.scans[number].runs, *[b""] * count)[:count]]
        sizes = [min(step, total - k * step) for k in range(count)] * len(frames)
        units = decode_scans(runs, layout, sizes).reshape(len(frames), count * step, 64)[:, :total]
        for c, place in places.items():
            out[c] = units[:, place]
    return out


def plane(frame: Frame, units: np.ndarray, part: int = 0) -> np.ndarray:
    """Samples (frames, height, width) of a component from its coefficients."""
    n, down, across, _ = units.shape
    quantisers = np.frombuffer(frame.quantisers[part], ">u2")
    plain = (quantisers == 1).all()
    blocks = pixels(units.reshape(n, down * across, 64), None if plain else quantisers).reshape(n, down, across, 8, 8)
    w, h = frame.size_of(part)
    return blocks.swapaxes(2, 3).reshape(n, down * 8, across * 8)[:, :h, :w]
