"""Motion-JPEG media columns: AVI files of intra frames, read by their RIFF index, decoded and cut into shots.

Frames are 8 x 8 pixels of three 8-bit components (192 samples), coded by JPEG's lossless process (left prediction, Huffman-coded
differences), so a payload comes back bit for bit. The reader walks the RIFF chunks, takes frames from `idx1` (or from the `movi`
list where there is no index), undoes byte stuffing and decodes the frames of many files at once: step by step through the samples,
all frames side by side. A shot begins where the histogram difference to the frame before exceeds an adaptive bound: the mean plus
`sharpness` standard deviations of the differences around it, and a floor; shots have at least `least` frames.

Memory: files are handled in pieces of a few MB, one file at least. Nothing is shuffled.

Defined cases. Null text: the empty text, whose payload is 192 spaces: one frame, one clip. Null doc_id and repeated rows: kept;
equal texts give equal files. Empty table: no rows. Very long texts: one file, whole, decoded in ranges of frames. A null file in clips() gives no
rows, a malformed one, or one without a frame rate, one row with the error. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.textkit import spans, text_pieces

SIDE, PARTS, FRAME, FPS = 8, 3, 192, 25
#: Lengths of the Huffman codes of difference categories 0 to 8 (the JPEG standard's typical DC table).
CODE_BITS = [2, 3, 3, 3, 3, 3, 4, 5, 6]

DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_shots int"
CLIPS = "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, difference double, error string"


def _codes(bits: list[int]) -> list[int]:
    """Canonical Huffman codes of symbols in order of their code lengths."""
    out, code, last = [], 0, bits[0]
    for n in bits:
        code <<= n - last
        out.append(code)
        code, last = code + 1, n
    return out


def _header(bits: list[int]) -> bytes:
    """Everything before a frame's entropy-coded bytes."""
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, PARTS) + b"".join(bytes([c, 0x11, 0]) for c in b"RGB")
    table = bytes([0]) + bytes(bits.count(n) for n in range(1, 17)) + bytes(range(len(bits)))
    scan = bytes([PARTS]) + b"".join(bytes([c, 0]) for c in b"RGB") + bytes([1, 0, 0])
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, table) + segment(0xDA, scan)


HEADER = _header(CODE_BITS)
_D = np.arange(-255, 256)
_KIND = np.array([abs(int(d)).bit_length() for d in _D])
_LENGTH = (np.array(CODE_BITS)[_KIND] + _KIND).astype(np.int32)
_CODE = ((np.array(_codes(CODE_BITS))[_KIND] << _KIND) | np.where(_D >= 0, _D, _D - 1) & ((1 << _KIND) - 1)).astype(np.int32)


def _predictions(x: np.ndarray) -> np.ndarray:
    """The left neighbour; the one above at a row's start; 128 at the frame's."""
    out = np.empty_like(x)
    out[:, :, 1:] = x[:, :, :-1]
    out[:, 1:, 0] = x[:, :-1, 0]
    out[:, 0, 0] = 128
    return out


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of frames (n x 192 samples), end to end, and each frame's size."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE, PARTS).astype(np.int16)
    d = (x - _predictions(x)).reshape(n, FRAME) + 255
    length = _LENGTH[d]
    upto = np.cumsum(length, axis=1, dtype=np.int32)
    sizes = ((upto[:, -1] + 7) >> 3).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    at = ((base << 3).astype(np.int32)[:, None] + upto - length).ravel()  # callers pass at most 2**15 frames
    value = _CODE[d].ravel() << (24 - (at & 7) - length.ravel())
    byte = at >> 3
    first = np.flatnonzero(np.diff(byte, prepend=-1))
    value, byte = np.add.reduceat(value, first), byte[first]
    raw = np.zeros(int(sizes.sum()) + 2, np.int64)
    raw[byte] += value >> 16
    raw[byte + 1] += (value >> 8) & 255
    raw[byte + 2] += value & 255
    raw[base + sizes - 1] += (1 << (-upto[:, -1] & 7)) - 1  # the last byte is filled up with ones
    raw = raw[:-2].astype(np.uint8)
    full = np.flatnonzero(raw == 0xFF)
    return np.insert(raw, full + 1, np.uint8(0)), sizes + np.diff(np.searchsorted(full, np.append(base, len(raw))))


def _u32(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4)


def encode_files(payload: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """One AVI file for each count in `frames`, of the payload's frames in order."""
    total = int(frames.sum())
    coded, sizes = [], []
    for a in range(0, total, 1 << 15):
        c, s = encode_frames(payload[a * FRAME : (a + (1 << 15)) * FRAME].reshape(-1, FRAME))
        coded.append(c)
        sizes.append(s)
    scan, size = np.concatenate(coded), np.concatenate(sizes)
    picture = len(HEADER) + size + 2
    chunk = 8 + picture + (picture & 1)
    at = np.cumsum(chunk) - chunk
    movi = np.zeros(int(chunk.sum()), np.uint8)
    lead = 8 + len(HEADER)
    front = np.empty((total, lead), np.uint8)
    front[:] = np.frombuffer(b"00dc\0\0\0\0" + HEADER, np.uint8)
    front[:, 4:8] = _u32(picture)
    movi[(at[:, None] + np.arange(lead)).ravel()] = front.ravel()
    movi[spans(at + lead, size)] = scan
    movi[at + lead + size] = 0xFF
    movi[at + lead + size + 1] = 0xD9
    upto = np.concatenate([[0], np.cumsum(frames)])
    edges = np.append(at, len(movi))
    index = np.zeros((total, 16), np.uint8)
    index[:, :4] = np.frombuffer(b"00dc", np.uint8)
    index[:, 4] = 0x10  # a key frame
    index[:, 8:12] = _u32(at - np.repeat(edges[upto[:-1]], frames) + 4)
    index[:, 12:] = _u32(picture)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        n, body = b - a, movi[edges[a] : edges[b]].tobytes()
        main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
        stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
        form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", FRAME, 0, 0, 0, 0)
        strl = b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)
        hdrl = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", strl)
        out.append(_chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", index[a:b].tobytes())))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _walk(raw: memoryview, at: int, stop: int):
    """(name, start, size) of the chunks from `at` to `stop`."""
    while at + 8 <= stop:
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        if at + 8 + size > stop:
            raise ValueError("a chunk goes beyond its parent's end")
        yield bytes(raw[at : at + 4]), at + 8, size
        at += 8 + size + (size & 1)


def parse(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, float]:
    """Offsets and sizes of an AVI file's video frames, and the frames per second."""
    raw = memoryview(raw)
    if bytes(raw[:4]) != b"RIFF" or bytes(raw[8:12]) != b"AVI ":
        raise ValueError("no AVI file")
    movi = index = None
    fps = 0.0
    for name, start, size in _walk(raw, 12, 8 + int.from_bytes(raw[4:8], "little")):
        kind = bytes(raw[start : start + 4])
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, n in _walk(raw, start + 4, start + size):
                if inner == b"avih":
                    fps = fps or 1e6 / max(1, int.from_bytes(raw[a : a + 4], "little"))
                elif inner == b"LIST" and bytes(raw[a : a + 4]) == b"strl":
                    for deep, b, _ in _walk(raw, a + 4, a + n):
                        if deep == b"strh" and bytes(raw[b : b + 4]) == b"vids":
                            scale, rate = struct.unpack_from("<II", raw, b + 20)
                            fps = rate / max(1, scale)
        elif name == b"LIST" and kind == b"movi":
            movi = (start, size)
        elif name == b"idx1":
            index = np.frombuffer(raw[start : start + size - size % 16], np.uint8).reshape(-1, 16)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        found = [(a, n) for name, a, n in _walk(raw, movi[0] + 4, sum(movi)) if name[2:] in (b"dc", b"db")]
        at, size = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    else:
        index = index[(index[:, 2] == ord("d")) & ((index[:, 3] == ord("c")) | (index[:, 3] == ord("b")))]
        at, size = (np.ascontiguousarray(index[:, a : a + 4]).view("<u4").ravel().astype(np.int64) for a in (8, 12))
        if len(at):  # offsets count from the movi list's name, in some files from the file's start
            at = at + (8 if bytes(raw[at[0] : at[0] + 4]) == bytes(index[0, :4]) and at[0] > movi[0] else movi[0] + 8)
    if len(at) and int((at + size).max()) > len(raw):
        raise ValueError("a frame goes beyond the file's end")
    return at, size, fps


def _picture(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a frame's bytes: the length of what is before the entropy-coded part, and what each 16 bits begin with: bits taken and difference."""
    at, bits, shape = 2, None, None
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while at + 4 <= len(raw):
        mark, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if raw[at - 2 - size] != 0xFF:
            raise ValueError("no JPEG marker")
        if mark == 0xC3:
            shape = struct.unpack_from(">BHHB", body)
        elif mark == 0xC4:
            counts, symbols = body[1:17], body[17:]
            bits = dict(zip(symbols, [n + 1 for n, c in enumerate(counts) for _ in range(c)]))
        elif mark == 0xDA:
            break
    if shape != (8, SIDE, SIDE, PARTS) or bits is None or body[-3:] != bytes([1, 0, 0]):
        raise ValueError("not a frame of this kind: lossless, 8 x 8 pixels, three 8-bit components, left prediction")
    took, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16)
    order = sorted(bits, key=lambda s: bits[s])
    for symbol, code in zip(order, _codes([bits[s] for s in order])):
        n = bits[symbol] + symbol
        if n > 16:
            continue
        more = np.arange(1 << symbol)
        diff = np.where(more >> max(0, symbol - 1) & 1, more, more - (1 << symbol) + 1) if symbol else more
        lo, width = code << (16 - bits[symbol]), 1 << (16 - n)
        took[lo : lo + (width << symbol)] = n
        value[lo : lo + (width << symbol)] = np.repeat(diff, width)
    return at, took, value


def decode_frames(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples (n x 192) of the frames at `at` in `data`."""
    out = np.empty((len(at), FRAME), np.uint8)
    todo = np.arange(len(at))
    while len(todo):  # once for all frames with the same header, which mostly are all
        i = int(todo[0])
        lead, took, value = _picture(data[at[i] : at[i] + size[i]].tobytes())
        same = (size[todo] > lead) & (data[np.minimum(at[todo][:, None] + np.arange(lead), len(data) - 1)] == data[at[i] : at[i] + lead]).all(1)
        mine, todo = todo[same], todo[~same]
        for a in range(0, len(mine), 1 << 13):
            part = mine[a : a + (1 << 13)]
            out[part] = _decode(data, at[part] + lead, size[part] - lead - 2, took, value)
    return out


def _decode(data: np.ndarray, at: np.ndarray, size: np.ndarray, took: np.ndarray, value: np.ndarray) -> np.ndarray:
    if (size <= 0).any():
        raise ValueError("a frame without samples")
    raw = data[spans(at, size)]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
    first = np.cumsum(size) - size
    left = np.concatenate([[0], np.cumsum(keep)])
    base, end = left[first], left[first + size]
    b = np.concatenate([raw[keep], np.full(4, 255, np.uint8)]).astype(np.int64)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    pos, diffs = base << 3, np.empty((FRAME, len(at)), np.int16)
    for k in range(FRAME):
        peek = (window[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF
        diffs[k] = value[peek]
        pos += took[peek]
        np.minimum(pos, (len(b) - 4) << 3, out=pos)
    if (pos > end << 3).any() or (pos <= (end - 1) << 3).any():
        raise ValueError("a frame's bits don't end where its bytes do")
    x = diffs.T.reshape(-1, SIDE, SIDE, PARTS).astype(np.int64)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2) & 255).astype(np.uint8).reshape(-1, FRAME)


def shots(samples: np.ndarray, frames: np.ndarray, reach: int = 8, sharpness: float = 3.0, floor: float = 0.15, least: int = 4) -> list[list[tuple[int, int, float]]]:
    """(first, last frame, difference at its start) of the shots of each file."""
    n, upto = len(samples), np.concatenate([[0], np.cumsum(frames)])
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    step = np.zeros(n, np.int64)
    step[1:] = np.abs(np.diff(bins, axis=0)).sum(1)  # 0 to 384
    step[upto[:-1][frames > 0]] = 0
    start, stop = np.repeat(upto[:-1], frames), np.repeat(upto[1:], frames)
    i = np.arange(n)
    lo, hi = np.maximum(start + 1, i - reach), np.minimum(stop, i + reach + 1)
    one, two = np.concatenate([[0], np.cumsum(step)]), np.concatenate([[0], np.cumsum(step * step)])
    count = np.maximum(hi - lo - 1, 1)  # of the differences around, without its own
    mean = (one[hi] - one[np.minimum(lo, hi)] - step) / count
    spread = np.sqrt(np.maximum((two[hi] - two[np.minimum(lo, hi)] - step * step) / count - mean * mean, 0))
    cuts = np.flatnonzero((i > start) & (step > mean + sharpness * spread) & (step >= floor * 2 * FRAME))
    out, by = [], np.searchsorted(cuts, upto)
    for a, b, c, d in zip(upto[:-1].tolist(), upto[1:].tolist(), by[:-1].tolist(), by[1:].tolist()):
        begins = [a]
        for cut in cuts[c:d].tolist():
            if cut - begins[-1] >= least and b - cut >= least:
                begins.append(cut)
        out.append([(s - a, e - a - 1, step[s] / (2 * FRAME)) for s, e in zip(begins, [*begins[1:], b])] if b > a else [])
    return out


def _files(texts: pa.Array):
    """(first text, sizes of texts, frames, AVI files) of each piece of texts."""
    for lo, data, offsets in text_pieces(texts):
        sizes = np.diff(offsets)
        frames = np.maximum(1, -(-sizes // FRAME))
        payload = np.full(int(frames.sum()) * FRAME, 32, np.uint8)
        first = (np.cumsum(frames) - frames) * FRAME
        payload[spans(first, sizes)] = data
        yield lo, sizes, frames, encode_files(payload, frames)


def _read(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """All samples of files, their numbers of frames and frames per second."""
    sizes = np.array([len(f) for f in files])
    parsed = [parse(f) for f in files]
    frames = np.array([len(p[0]) for p in parsed])
    data = np.frombuffer(b"".join(files), np.uint8)
    at = np.concatenate([p[0] for p in parsed]) + np.repeat(np.cumsum(sizes) - sizes, frames)
    return decode_frames(data, at, np.concatenate([p[1] for p in parsed])), frames, [p[2] for p in parsed]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file of every text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, sizes, _, files in _files(batch.column("text")):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(files)), pa.array(sizes), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame, **options) -> DataFrame:
    """Timed clip rows of AVI files in columns doc_id and media; options: those of shots(). A file that can't be read gives one row, with the error and
    no clip."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, file in zip(ids, batch.column("media").to_pylist()):
                if file is None:
                    continue
                try:
                    samples, frames, fps = _read([file])
                    if not fps[0]:
                        raise ValueError("no frame rate")
                except (ValueError, struct.error, IndexError) as e:  # of what the file holds; it has no clips
                    rows.append((doc, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(doc, k, a, b, a / fps[0], (b + 1) / fps[0], float(d), None) for k, (a, b, d) in enumerate(shots(samples, frames, **options)[0])]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in CLIPS.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, CLIPS)


def digest(docs: DataFrame, **options) -> DataFrame:
    """Stores every text as a file, reads it back and describes both: sizes, checksums and clips. The files themselves aren't kept."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, sizes, _, files in _files(batch.column("text")):
                samples, frames, fps = _read(files)
                flat, upto, rows = samples.ravel(), np.concatenate([[0], np.cumsum(frames)]) * FRAME, []
                for i, (file, cut) in enumerate(zip(files, shots(samples, frames, **options))):
                    payload = flat[upto[i] : upto[i + 1]].tobytes()
                    times = ",".join(f"{a / fps[i]:.2f}-{(b + 1) / fps[i]:.2f}" for a, b, _ in cut)
                    rows.append((ids[lo + i], int(sizes[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), f"{frames[i]} frames; clips {times}", int(frames[i]), len(cut)))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
