"""Token counts of huge texts by overlap resynchronisation.

A long text is encoded as overlapping chunks. Every token's length in bytes is known from the vocabulary, so
each encoding gives the offsets of its token boundaries. Neighbouring chunks are spliced at a boundary
that both have in their overlap and that is proven stable: it stands before a space that follows another
character, and no piece of the vocabulary reaches across such a place (checked when the model is
loaded), so no merge does either. If an overlap holds no such place it is widened, up to one chunk
for the whole text.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of the overlap of two chunks.
CHUNK = 2048
OVERLAP = 64
#: Texts that one call encodes together hold about so many characters.
BATCH_CHARS = 1 << 20

_MARK = "▁"  # stands for a space in pieces


class Counter:
    """Counts tokens like ``SentencePieceProcessor.encode`` of the model at ``path``."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.sizes = np.array([
            1 if self.model.is_byte(i) else len(p.replace(_MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        probe = "a  b \né 　 c"
        # Chunks are only possible if spaces are kept as they are and no piece crosses into a word gap.
        self.splits = (all(_MARK not in p.lstrip(_MARK) for p in pieces)
                       and int(self.sizes[self.model.encode(probe)].sum()) == 1 + len(probe.encode()))

    def counts(self, texts: list[str]) -> list[int]:
        jobs = []  # (text, start, stop): the chunks of all texts, encoded in one call
        for i, text in enumerate(texts):
            if len(text) <= 2 * self.chunk or not self.splits or _MARK in text:
                jobs.append((i, 0, len(text)))
            else:
                jobs += [(i, at, min(len(text), at + self.chunk + self.overlap))
                         for at in range(0, len(text) - self.overlap, self.chunk)]
        encoded = self.model.encode([texts[i][a:b] for i, a, b in jobs], num_threads=1)
        totals = [0] * len(texts)
        at = 0
        while at < len(jobs):
            end = at
            while end < len(jobs) and jobs[end][0] == jobs[at][0]:
                end += 1
            i = jobs[at][0]
            totals[i] = (len(encoded[at]) if end == at + 1
                         else self._spliced(texts[i], [(a, b, e) for (_, a, b), e in zip(jobs[at:end], encoded[at:end])]))
            at = end
        return totals

    def _ends(self, ids) -> np.ndarray:
        """Bytes of the chunk before the end of each token; the space put before a chunk is not part of it."""
        return np.cumsum(self.sizes[ids]) - 1

    def _spliced(self, text: str, chunks: list) -> int:
        start, stop, ids = chunks[0]
        ends = self._ends(ids)
        total, begin = 0, -1  # tokens counted so far; they end at this byte of the left chunk
        for next_start, next_stop, next_ids in chunks[1:]:
            while True:
                next_ends = self._ends(next_ids)
                lead = len(text[start:next_start].encode())
                common = _stable(text[next_start:stop].encode())
                common = common[np.isin(common, next_ends) & np.isin(common + lead, ends) & (common + lead > begin)]
                if len(common):
                    place = int(common[len(common) // 2])
                    total += _through(ends, place + lead) - _through(ends, begin)
                    start, stop, ends, begin = next_start, next_stop, next_ends, place
                    break
                if next_start == start:  # nowhere to splice: both chunks become one
                    stop, ends = next_stop, next_ends
                    break
                next_start = max(start, stop - 2 * (stop - next_start))  # widen the overlap
                next_ids = self.model.encode(text[next_start:next_stop])
        return total + len(ends) - _through(ends, begin)


def _through(ends: np.ndarray, place: int) -> int:
    """How many tokens end at ``place`` or before."""
    return int(np.searchsorted(ends, place, side="right"))


def _stable(raw: bytes) -> np.ndarray:
    """Offsets of spaces that follow something else and are not the last byte."""
    data = np.frombuffer(raw, np.uint8)
    place = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
    return place[place < len(data) - 1]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(path):
    def rows(batches):
        tool = counter(path)
        for batch in batches:
            lengths = pc.utf8_length(batch.column("text")).to_pylist()
            start = size = 0
            for i, n in enumerate([*lengths, None]):
                if n is None or (i > start and size + n > BATCH_CHARS):
                    part = batch.slice(start, i - start)
                    if part.num_rows:
                        texts = part.column("text")
                        yield pa.RecordBatch.from_arrays(
                            [part.column("row"), pc.cast(pc.binary_length(texts), pa.int64()),
                             pa.array(tool.counts(texts.to_pylist()), pa.int64())], ["row", "n_bytes", "n_tokens"])
                    start, size = i, 0
                size += n or 0

    return rows


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row`` (the other columns of ``df``), ``n_bytes`` (UTF-8) and ``n_tokens`` of every text.

    Counts as the library does without begin or end tokens. A null text counts as empty and has no tokens. One
    pass without a shuffle; a task holds one Arrow batch. Columns of any name pass inside ``row``.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = df.select(F.struct(*others).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return packed.mapInArrow(_counted(path),
                             f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per row of ``(doc_id, text)``: size, tokens, and whether there are more than ``limit``."""
    return count_tokens(docs.select("doc_id", "text"), path).select(
        "row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
