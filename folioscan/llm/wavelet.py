"""Wavelet matrix of token ids: one compressed file that answers access, counting and occurrence lookup.

File format, all numbers little-endian:

    8 bytes   magic "WMTOKEN1"
    4 bytes   length of the JSON header, then the header
    ...       zstd blocks in the order and with the byte lengths that the header lists

Blocks: "symbols" (uint32 ids of the shard by falling frequency; a token's code is its id's place
here, so the high planes are sparse and compress well), "docs" (int64 document ids, with a null
mask block "nulls"), "lengths" (uint32 tokens of each document), then one block a bit-plane, from
the highest bit, each packed 8 tokens a byte. Rank directories are counts a block of 512 bits,
built as a plane is first opened; select is a binary search over them.
"""

from __future__ import annotations

import json
import struct

import numpy as np

MAGIC = b"WMTOKEN1"
#: Bits counted together by the rank directory.
RANK_BITS = 512


class WaveletError(ValueError):
    """A file that isn't a whole wavelet matrix."""


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, level: int = 3) -> bytes:
    """The file for these uint32 ids, which are the documents' ids one after another. Empty input makes a valid file."""
    import zstandard

    ids = np.asarray(ids, dtype=np.uint32)
    symbols, inverse = _by_frequency(ids)
    bits = max(1, int(max(len(symbols) - 1, 0)).bit_length())
    codes = inverse.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, parted = [], np.empty_like(codes)
    for at in range(bits - 1, -1, -1):
        bit = (codes >> codes.dtype.type(at)).astype(np.uint8)
        bit &= 1
        ones = bit.view(bool)
        planes.append(np.packbits(ones).tobytes())
        zeros = len(ones) - int(np.count_nonzero(ones))
        np.compress(~ones, codes, out=parted[:zeros])
        np.compress(ones, codes, out=parted[zeros:])
        codes, parted = parted, codes
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = [("symbols", symbols.astype("<u4").tobytes()), ("docs", np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()), ("nulls", nulls.tobytes()), ("lengths", np.asarray(lengths, dtype="<u4").tobytes())]
    named += [(f"plane{k}", p) for k, p in enumerate(planes)]
    squeeze = zstandard.ZstdCompressor(level=level)
    blocks = [squeeze.compress(data) for _, data in named]
    header = json.dumps({"n": len(ids), "bits": bits, "n_docs": len(doc_ids), "blocks": [[name, len(b)] for (name, _), b in zip(named, blocks, strict=True)]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *blocks])


def _by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids by falling count, then id; and each token's place among them."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        place = np.zeros(len(counts), np.uint32)
        place[symbols] = np.arange(len(symbols), dtype=np.uint32)
        return symbols.astype(np.uint32), place[ids]
    distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return distinct[order], place[inverse]


class WaveletMatrix:
    """Opened from the bytes of one file; planes are unpacked when first needed."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 12:
            raise WaveletError("no wavelet matrix: wrong first bytes")
        size = struct.unpack("<I", data[8:12])[0]
        try:
            head = json.loads(data[12 : 12 + size])
        except ValueError as e:
            raise WaveletError("the header is damaged") from e
        self.n, self.bits, self.n_docs = head["n"], head["bits"], head["n_docs"]
        at, self._blocks = 12 + size, {}
        for name, length in head["blocks"]:
            self._blocks[name] = (at, length)
            at += length
        if at != len(data):
            raise WaveletError(f"{len(data)} bytes, but the header lists {at}")
        self._data = data
        self._planes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.symbols = np.frombuffer(self._block("symbols"), dtype="<u4")

    def _block(self, name: str) -> bytes:
        import zstandard

        at, length = self._blocks[name]
        try:
            return zstandard.ZstdDecompressor().decompress(self._data[at : at + length])
        except zstandard.ZstdError as e:
            raise WaveletError(f"block {name} is damaged") from e

    def doc_ids(self) -> list[int | None]:
        ids, nulls = np.frombuffer(self._block("docs"), dtype="<i8"), np.frombuffer(self._block("nulls"), dtype=np.uint8)
        return [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._block("lengths"), dtype="<u4")

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Packed bits, ones before each block of RANK_BITS, and the number of zeros."""
        if k not in self._planes:
            packed = np.frombuffer(self._block(f"plane{k}"), dtype=np.uint8)
            step = RANK_BITS // 8
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % step))).reshape(-1, step).sum(1, dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(ones)])
            self._planes[k] = packed, before, self.n - int(before[-1])
        return self._planes[k]

    def _bit(self, k: int, i: int) -> int:
        return int(self._plane(k)[0][i >> 3] >> (7 - (i & 7))) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        packed, before, _ = self._plane(k)
        block = i // RANK_BITS
        whole, rest = divmod(i - block * RANK_BITS, 8)
        at = block * RANK_BITS // 8
        count = int(before[block]) + int(np.bitwise_count(packed[at : at + whole]).sum())
        return count + (int(packed[at + whole] >> (8 - rest)).bit_count() if rest else 0)

    def access(self, i: int) -> int:
        """The id of token i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self._plane(k)[2] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.symbols[code])

    def _path(self, token: int) -> list[int] | None:
        found = np.flatnonzero(self.symbols == token)
        return [int(found[0]) >> k & 1 for k in range(self.bits - 1, -1, -1)] if len(found) else None

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i tokens."""
        if (path := self._path(token)) is None:
            return 0
        low, high = 0, min(max(i, 0), self.n)
        for k, bit in enumerate(path):
            a, b, zeros = self._ones(k, low), self._ones(k, high), self._plane(k)[2]
            low, high = (zeros + a, zeros + b) if bit else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of occurrence j, from 0; -1 if there are not so many."""
        if j < 0 or (path := self._path(token)) is None or j >= self.count(token):
            return -1
        low = 0
        for k, bit in enumerate(path):
            ones, zeros = self._ones(k, low), self._plane(k)[2]
            low = zeros + ones if bit else low - ones
        at = low + j
        for k in range(self.bits - 1, -1, -1):
            at = self._find(k, path[k], at - self._plane(k)[2] if path[k] else at)
        return at

    def _find(self, k: int, bit: int, j: int) -> int:
        """The place of bit number j of this kind in a plane, by binary search over ranks."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            ones = self._ones(k, mid)
            if (ones if bit else mid - ones) <= j:
                low = mid
            else:
                high = mid
        return low

    def decode(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for at, k in enumerate(range(self.bits - 1, -1, -1)):
            ones = np.unpackbits(np.frombuffer(self._block(f"plane{k}"), dtype=np.uint8), count=self.n).view(bool)
            zeros = self.n - int(np.count_nonzero(ones))
            above = np.empty_like(codes)
            above[~ones], above[ones] = codes[:zeros], codes[zeros:]
            codes = above | (ones.astype(codes.dtype) << codes.dtype.type(at))
        return self.symbols[codes] if self.n else np.zeros(0, np.uint32)
