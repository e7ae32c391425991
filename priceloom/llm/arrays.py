"""Texts as flat byte arrays: slices of bounded size, prefix hashes, word and shingle hashes.

Tasks read texts as Arrow columns. An Arrow string column already is one byte buffer with row
offsets, so numpy works on whole slices of rows at once; no Python loop touches a byte.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SYMBOLS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a record batch into runs of rows whose texts hold about ``limit`` bytes."""
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and the offset at which each begins (one more at the end)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, places, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base = _U(base)
        self.inverse = _U(pow(int(base), -1, 1 << 64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))


_POWERS = Powers(int(_BASE))


class PrefixHash:
    """Hashes of any range of a byte array in constant time each.

    A polynomial over random byte symbols modulo 2**64. Different ranges agree by chance once in 2**64;
    strings built to collide (a Thue-Morse word of 512 bytes and its complement, for some pairs of
    letters) exist.
    """

    def __init__(self, data: np.ndarray):
        _POWERS.reach(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOLS[data] * _POWERS.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _POWERS.down[start]

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from every position that has so many after it."""
        count = max(0, len(self.sums) - size)
        return (self.sums[size:size + count] - self.sums[:count]) * _POWERS.down[:count]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without white space, and for each text the number of its first word.

    A word never crosses the end of a text.
    """
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edges = np.diff(solid)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]) if len(inner) else inner
    begin = np.flatnonzero(edges == 1)
    end = np.flatnonzero(edges == -1)
    if len(cut):
        begin = np.sort(np.concatenate([begin, cut]))
        end = np.sort(np.concatenate([end, cut]))
    return begin, end, np.searchsorted(begin, offsets)


def shared_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring values."""
    count = len(keys) - width + 1
    if count <= 0:
        return keys[:0]
    padded = -(-len(keys) // width) * width
    block = np.full(padded, np.iinfo(keys.dtype).max, keys.dtype)
    block[:len(keys)] = keys
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])
