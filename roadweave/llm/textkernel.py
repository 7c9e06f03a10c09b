"""Array kernels over the UTF-8 bytes of many texts at once.

A chunk of documents is one byte buffer and the offsets of its texts, as Arrow stores it; words, n-grams
and byte windows come out as arrays of 64-bit hashes, so no text becomes a Python string here.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard

#: Fixed multipliers of the rolling hash (odd) and of the final mixing.
RADIX = 0x9E3779B97F4A7C15
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
NGRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

#: Bytes of the words: everything but white space, or ASCII letters and digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and len + 1 offsets into them; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of the bytes; ``span_hash`` takes spans out of them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(RADIX, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(RADIX_INVERSE, len(sums))[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word: a longest run of bytes of that kind within a document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    step = inside[1:] != inside[:-1]
    start, end = step & inside[1:], step & inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]  # a word that runs over the end of a text
    start[cut] = end[cut] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = MIX[0]) -> np.ndarray:
    """64 bits of every word: eight bytes after another are mixed in, then the length; longer than LONG_WORD, a digest of the bytes."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = np.full(len(starts), salt, np.uint64)
    left = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(left):
        part = at_byte[starts[left] + done]
        spare = 8 * np.maximum(0, done + 8 - size[left]).astype(np.uint64)
        part = part << spare  # bytes behind the word fall out
        out[left] = mix(out[left] * np.uint64(RADIX) ^ part)
        done += 8
        left = left[size[left] > done]
    out = mix(out + size.astype(np.uint64) * np.uint64(NGRAM[0]))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        raw = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(raw, "little")
    return out


def alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of each kind of hash, and the number of each hash's kind. Hashes are told apart by the bits above those
    that count them (43 and more for two million), so ``same_bytes`` must hold what is taken for alike against the bytes."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    packed = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))  # plain numbers sort far faster than their order
    order, kind = (packed & low).astype(np.int64), packed & ~low
    new = np.ones(len(hashes), bool)
    new[1:] = kind[1:] != kind[:-1]
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span has the bytes of the span whose number ``other`` gives."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    left = np.flatnonzero(other != np.arange(len(starts)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return bool(equal_spans(padded, starts[left], padded, starts[other[left]], size[left]).all())


def equal_spans(one: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the other array's span of that size. Eight bytes follow the last span of both arrays."""
    eight, other_eight = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (one, other))
    same = np.ones(len(starts), bool)
    left = np.flatnonzero(size > 0)
    done = 0
    while len(left):
        spare = 8 * np.maximum(0, done + 8 - size[left]).astype(np.uint64)
        alike = ((eight[starts[left] + done] ^ other_eight[other_starts[left] + done]) << spare) == 0
        same[left[~alike]] = False
        done += 8
        left = left[alike & (size[left] > done)]
    return same


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, most: int = 1 << 20, salt: int = MIX[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of every word, A-Z counting as a-z. Documents are taken in runs of about ``most`` bytes."""
    found = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, doc = word_spans(part, offsets[first : last + 1] - offsets[first], kind)
        found.append((word_hash(part, starts, ends, salt), doc + first, starts + offsets[first]))
        first = last
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one document."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * np.uint64(NGRAM[k])
    return mix(total), doc[:size] == doc[n - 1 : n - 1 + size]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers: the first, then differences of the fewest whole bytes that hold them all.

    Highest bytes stand apart, compressed: differences of hashes are mostly far below the largest.
    """
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    top = zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(body[:, width - 1]).tobytes())
    return b"".join([bytes([width]), len(top).to_bytes(4, "little"), values[:1].astype("<u8").tobytes(), top, np.ascontiguousarray(body[:, : width - 1]).tobytes()])


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width, size = raw[0], int.from_bytes(raw[1:5], "little")
    top = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[13 : 13 + size]), np.uint8)
    wide = np.zeros((len(top) + 1, 8), np.uint8)
    wide[1:, width - 1] = top
    if width > 1:
        wide[1:, : width - 1] = np.frombuffer(raw, np.uint8, offset=13 + size).reshape(-1, width - 1)
    wide[0] = np.frombuffer(raw, np.uint8, 8, 5)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64)


def joined(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of whole numbers, or bytes, as one string; ``parted`` gives them back."""
    raw = [x if isinstance(x, bytes) else f"{x.dtype.itemsize}".encode() + x.tobytes() for x in arrays]
    return np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)


def parted(raw: bytes, *kinds: type) -> list:
    """``kinds``: for each part bytes, or anything else for an array of unsigned whole numbers."""
    n = int.from_bytes(raw[:4], "little")
    sizes, at, out = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        part, at = raw[at : at + size], at + size
        out.append(part if kind is bytes else np.frombuffer(part, f"<u{part[:1].decode()}", offset=1))
    return out
