"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Every window of a document as long as a benchmark item gets the SimHash of its word shingles. Item
fingerprints stand in a multi-index: eight blocks of eight bits, each open to two flipped bits, so
that every item within ``RADIUS`` bits of a window agrees in some block and becomes a candidate.
Candidates are verified by the weighted (multiset) similarity of their shingles.

Similarity ``s`` of two windows of ``m`` shingles means ``2 m s / (1 + s)`` shared ones, so a window that holds
fewer shingles of the benchmark cannot reach it and gets no fingerprint; nothing is lost by that.

A text with fewer words than an item is one window as a whole: its fingerprint goes through the multi-index of
the items of up to ``1 / similarity`` times as many shingles.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.llm.arrays import PrefixHash, flat, mix, slices, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits within which an item is certain to be found: eight blocks, two flips in each allow for 8 * 3 - 1.
RADIUS = 23
#: A block of items that travels to the tasks holds about so many items and text bytes at most.
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 16 << 20
#: Windows that are fingerprinted together.
WINDOWS = 2048

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _shingles(word: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(word) - size + 1), _U)
    for j in range(size):
        out = out * _U(0xD1342543DE82EF95) + word[j:j + len(out)]
    return mix(out)


def _word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII letters in lower case) and the number of the first word of each text."""
    data, offsets = flat(column)
    data = _LOWER[data]
    begin, end, first = words(data, offsets)
    return mix(PrefixHash(data).of(begin, end) + (end - begin).astype(_U)), first


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes; a repeated shingle weighs as often as it stands there."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=2,
                         bitorder="little")
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > shingles.shape[1], axis=1, bitorder="little").view(_U)[:, 0]


class Index:
    """Items by the number of words, with the multi-index of each length."""

    def __init__(self, items: list, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS):
        self.similarity, self.size = similarity, size
        lengths: dict[int, list] = {}
        texts = pa.array([text for _, text in items], pa.string())
        hashes, first = _word_hashes(texts) if len(items) else (np.zeros(0, _U), np.zeros(1, np.int64))
        for i, (item_id, _) in enumerate(items):
            own = hashes[first[i]:first[i + 1]]
            if len(own):
                k = min(size, len(own))
                shingles = _shingles(own, k)
                lengths.setdefault(len(own), []).append((item_id, Counter(shingles.tolist()), shingles))
        self.classes = []
        for n, members in sorted(lengths.items()):
            prints = np.concatenate([simhash(s[None, :]) for _, _, s in members])
            blocks = prints.view(np.uint8).reshape(-1, 8)
            near = np.stack([np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ blocks[None, :, b]) <= 2
                             for b in range(8)])
            known = np.unique(np.concatenate([s for _, _, s in members]))
            self.classes.append((n, members, prints, near, known))
        self.sizes = sorted({min(size, n) for n in lengths})
        every = {k: [c[4] for c in self.classes if min(size, c[0]) == k] for k in self.sizes}
        self.known = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        # A small table of hash prefixes rules out most shingles before the search.
        self.seen = {k: np.zeros(1 << 16, bool) for k in self.sizes}
        for k, v in self.known.items():
            self.seen[k][(v >> _U(48)).astype(np.int64)] = True

    def _marks(self, shingles, k):
        maybe = np.flatnonzero(self.seen[k][(shingles >> _U(48)).astype(np.int64)])
        known = self.known[k]
        place = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        return maybe[known[place] == shingles[maybe]]

    def matches(self, column):
        """``(row, item_id, similarity, first word)`` of the best window of each item in each text."""
        hashes, first = _word_hashes(column)
        best: dict = {}
        for k in self.sizes:
            shingles = _shingles(hashes, k)
            marked = self._marks(shingles, k)
            if not len(marked):
                continue
            total = np.zeros(len(shingles) + 1, np.int32)
            total[marked + 1] = 1
            total = np.cumsum(total)
            self._verify_short(shingles, total, k, first, best)
            for n, members, prints, near, _ in self.classes:
                if min(self.size, n) != k:
                    continue
                m = n - k + 1
                need = int(np.ceil(2 * m * self.similarity / (1 + self.similarity) - 1e-9))
                start = self._starts(marked, m, len(hashes) - n)
                row = np.searchsorted(first, start, side="right") - 1
                start = start[(start + n <= first[np.minimum(row + 1, len(first) - 1)])]
                start = start[total[start + m] - total[start] >= need]
                for at in range(0, len(start), WINDOWS):
                    self._verify(start[at:at + WINDOWS], shingles, m, members, prints, near, first, best)
        return [(row, item, s, int(p - first[row])) for (row, item), (s, p) in sorted(
            best.items(), key=lambda x: (x[0][0], str(x[0][1])))]

    def _verify_short(self, shingles, total, k, first, best):
        """Texts with fewer words than an item, each as a whole against the longer items of similar length."""
        size = np.maximum(0, np.diff(first) - k + 1)
        begin = np.minimum(first[:-1], len(shingles))
        # An item holds more shingles than the text, so at least 2 m s / (1 + s) of the text's m are shared.
        need = 2 * size * self.similarity / (1 + self.similarity) - 1e-9
        for row in np.flatnonzero((size > 0) & (total[np.minimum(begin + size, len(shingles))] - total[begin] >= need)):
            m = int(size[row])
            window = shingles[begin[row]:begin[row] + m]
            print_, counts = simhash(window[None, :]), Counter(window.tolist())
            for n, members, prints, near, _ in self.classes:
                longer = n - k + 1
                if min(self.size, n) != k or not m < longer <= m / self.similarity + 1e-9:
                    continue
                for _, i in self._candidates(print_, prints, near):
                    shared = sum((counts & members[i][1]).values())
                    similarity = shared / (m + longer - shared)
                    if similarity >= self.similarity and similarity > best.get((int(row), members[i][0]), (0.0, 0))[0]:
                        best[int(row), members[i][0]] = similarity, int(first[row])

    @staticmethod
    def _candidates(found, prints, near):
        """``(window, item)`` of all fingerprints within ``RADIUS``: those that agree in a block, then counted exactly."""
        blocks = found.view(np.uint8).reshape(-1, 8)
        candidate = np.zeros((len(found), len(prints)), bool)
        for b in range(8):
            candidate |= near[b][blocks[:, b]]
        w, i = np.nonzero(candidate)
        within = np.bitwise_count(found[w] ^ prints[i]) <= RADIUS
        return zip(w[within].tolist(), i[within].tolist())

    @staticmethod
    def _starts(marked, m, last):
        """Window starts that hold a marked shingle, without repeats."""
        low = np.maximum(marked - m + 1, np.r_[0, marked[:-1] + 1])
        count = np.maximum(0, marked - low + 1)
        start = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return start[start <= last]

    def _verify(self, start, shingles, m, members, prints, near, first, best):
        windows = shingles[start[:, None] + np.arange(m)]
        for w, i in self._candidates(simhash(windows), prints, near):
            shared = sum((Counter(windows[w].tolist()) & members[i][1]).values())
            similarity = shared / (2 * m - shared)
            if similarity >= self.similarity:
                key = int(np.searchsorted(first, start[w], side="right") - 1), members[i][0]
                if similarity > best.get(key, (0.0, 0))[0]:
                    best[key] = similarity, int(start[w])


def _blocks(items: DataFrame):
    """The benchmark, in blocks of bounded size."""
    items = items.where("text is not null").select("item_id", "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES))
    for block in range(count if size.n else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, r.text) for r in part.collect()]


def _found(items, similarity, item_type):
    def rows(batches):
        index = Index(items, similarity)
        for batch in batches:
            for part in slices(batch, "text"):
                hits = index.matches(part.column("text"))
                if hits:
                    row, item, score, first = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(pa.array(row)), pa.array(item, item_type), pa.array(score, pa.float64()),
                         pa.array(first, pa.int64())], ["row", "item_id", "similarity", "first_word"])

    return rows


def _clean(items, similarity):
    def rows(batches):
        index = Index(items, similarity)
        for batch in batches:
            for part in slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[hit[0] for hit in index.matches(part.column("text"))]] = False
                yield part.select(["row"]).filter(pa.array(keep))

    return rows


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``item_id``, ``similarity`` and ``first_word`` of the best window.

    One row per document and benchmark item with a window at least ``similarity`` alike; the earliest of
    equally good windows. Windows and items have equal numbers of words; a text shorter than the item is one window
    as a whole, its similarity the shared shingles over those of both. An item below five words is one
    shingle of all its words. Null and empty texts and items match nothing. Repeated items share their id
    if it is the same, else each is found. The benchmark is read in blocks, one pass over the documents each.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = items.schema["item_id"].dataType
    schema = (f"row {packed.schema['row'].dataType.simpleString()}, item_id {kind.simpleString()}, "
              "similarity double, first_word long")
    from pyspark.sql.pandas.types import to_arrow_type

    found = None
    for block in _blocks(items):
        part = packed.mapInArrow(_found(block, similarity, to_arrow_type(kind)), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; every other row stays as it is."""
    columns = docs.columns
    for block in _blocks(items):
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
        docs = packed.mapInArrow(_clean(block, similarity), f"row {packed.schema['row'].dataType.simpleString()}")
        docs = docs.select("row.*")
    return docs


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``(doc_id, item_id, similarity, first_word)`` of ``(doc_id, text)`` and ``(item_id, text)``."""
    return find_leaks(docs.select("doc_id", "text"), items).select("row.doc_id", "item_id", "similarity", "first_word")
