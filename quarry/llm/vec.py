"""Words and rolling hashes of whole Arrow text columns, in numpy.

Texts stay UTF-8 bytes; a polynomial prefix sum modulo 2**64 gives the hash of any span in O(1), so a pass over a column costs a few
nanoseconds a byte and makes no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
RADIX = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(RADIX, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)

#: Bytes that end a word: for SPACED only ASCII white space and control bytes, for ALNUM all of ASCII but letters and digits.
SPACED = np.arange(256) > 32
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

SLICE_BYTES = (1 << 20) - 4096


def _lean() -> None:
    """Arrays of a megabyte and more come straight from the system and go back to it: a worker that waits for its next task holds none of the last one's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_lean()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(at + 1, min(to, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offset of each row, n + 1 of them. A null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; the length stays."""
    out = LOWER[data]
    if len(data) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in the class `inside`; no run crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and its inverse for i up to n."""
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, RADIX, U), np.full(size, INVERSE, U)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers[size] = up, down
    return _powers[size]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * RADIX**i, n + 1 of them."""
    out = np.zeros(len(values) + 1, U)
    np.multiply(values, powers(len(values))[0][: len(values)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span that is the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hashes of every span of one width."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n] + U(width))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix(TABLE[data]), starts, ends)


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each row begin among all words, n + 1 of them."""
    return np.searchsorted(rows, np.arange(n + 1))


def char_index(data: np.ndarray) -> np.ndarray:
    """The number of characters before each byte, n + 1 of them."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


_zip, _unzip = None, None


def pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed byte planes."""
    global _zip
    _zip = _zip or zstandard.ZstdCompressor(level=1)
    parts = [np.array([len(columns)], np.int64).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T)
        raw = _zip.compress(planes.tobytes())
        parts += [np.array([len(c), c.itemsize, len(raw)], np.int64).tobytes(), c.dtype.str.ljust(8).encode(), raw]
    return b"".join(parts)


def unpack(blob: bytes, only: range | None = None) -> list[np.ndarray]:
    """The columns of pack(), or those in the range `only`."""
    global _unzip
    _unzip = _unzip or zstandard.ZstdDecompressor()
    (k,), at, out = np.frombuffer(blob, np.int64, 1), 8, []
    for number in range(k):
        n, width, size = np.frombuffer(blob, np.int64, 3, at).tolist()
        if only is not None and number not in only:
            at += 32 + size
            continue
        kind = bytes(blob[at + 24 : at + 32]).decode().strip()
        raw = _unzip.decompress(blob[at + 32 : at + 32 + size], max_output_size=max(1, n * width)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += 32 + size
    return out
