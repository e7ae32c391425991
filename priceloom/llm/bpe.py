"""Byte-level BPE encoding and decoding, with tree concatenation for long text.

Short texts are encoded in place. A long text is halved by length, wherever that falls, down to leaves. Leaves
are rows of their own and encoded in parallel, each as if it were a text. Neighbours are then joined pair by
pair up the tree: a window around the join, from a pre-token of the left side that the join cannot move, is
split again and grows until it cuts where the right side cuts. From there on both agree for good, because
splitting runs from left to right and knows nothing of what it has passed. Only pre-tokens of that window are
encoded again. In a very long pre-token the window is one of tokens and grows until its first token equals the
left side's and its last the right side's; tokens that stand side by side in a valid encoding stay valid, so the
result is exact in either case. Special tokens are found in the whole text beforehand and never halved.
"""

import hashlib
import json
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priceloom.llm.repeats import text_key
from priceloom.session import checkpointed

#: Characters of a leaf, and length from which a text is spread over tasks.
LEAF = 1 << 13
LONG = 1 << 15
#: How byte-level tokenizers split text before merging (a fixed value of this family).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes after a cut between pre-tokens that can decide it: two characters (a contraction, the end of blanks).
REACH = 8
#: Bytes from which a pre-token is joined by its tokens instead of encoded again.
PIECE = 1 << 10


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, others moved up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class Codec:
    """Encodes and decodes like ``Tokenizer.from_file(path)``, from the same vocabulary file.

    Merging is done by an engine that takes ranks in place of merge lists; the file is refused if its ids
    are not in merge order, if it normalises, pads or truncates, or splits in another way.
    """

    def __init__(self, path: str):
        text = open(path, encoding="utf-8").read()
        spec = json.loads(text)
        letters = _byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocabulary["".join(m)] for m in merges]
        split = spec["pre_tokenizer"]
        if (order != sorted(order) or spec["normalizer"] or spec["truncation"] or spec["padding"]
                or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.engine = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.library = Tokenizer.from_str(text)
        self.letters = {i: t for t, i in vocabulary.items()}
        self.lengths = np.zeros(max([*vocabulary.values(), *added.values()]) + 1, np.int64)
        self.lengths[list(self.letters)] = [len(t) for t in self.letters.values()]  # a letter is a byte
        self.specials = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.table = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in added.items()}

    def encode(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special="all")

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def leaves(self, text: str, size: int = LEAF):
        """``(stretch, part)``: a special token, or what lies between two, halved by length down to ``size`` characters."""
        at = 0
        for number, special in enumerate([*self.specials.finditer(text), None]):
            stop = special.start() if special else len(text)
            yield from ((2 * number, text[a:b]) for a, b in _halves(at, stop, size))
            if special:
                yield 2 * number + 1, special.group()
                at = special.end()

    def leaf(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and which of them begin a pre-token."""
        found = self.library.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        return np.array(found.ids, np.int64), np.r_[True, word[1:] != word[:-1]][:len(word)]

    def piece(self, letters: str) -> list[int]:
        """Merge one pre-token, given as letters that stand for its bytes."""
        return [t.id for t in self.library.model.tokenize(letters)]

    def spell(self, ids) -> str:
        return "".join(map(self.letters.__getitem__, ids.tolist()))

    def join(self, left, right):
        """One encoding from those of two neighbours."""
        (a, starts_a), (b, starts_b) = left, right
        end_a, end_b = np.cumsum(self.lengths[a]), np.cumsum(self.lengths[b])
        begin_a, begin_b = end_a - self.lengths[a], end_b - self.lengths[b]
        certain = np.flatnonzero(starts_a & (begin_a <= end_a[-1] - REACH))
        first = int(certain[-1]) if len(certain) else 0
        head = self.spell(a[first:])
        cuts_b = np.append(np.flatnonzero(starts_b), len(b))
        places_b = np.append(begin_b, end_b[-1])[cuts_b] + len(head)
        count = 4
        while True:
            stop = int(cuts_b[min(count, len(cuts_b) - 1)])
            window = head + self.spell(b[:stop])
            raw = b"".join(map(self.table.__getitem__, [*a[first:].tolist(), *b[:stop].tolist()]))
            pieces = [letters for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(raw.decode())]
            cuts = np.cumsum([len(p) for p in pieces])
            last = len(window) - (0 if stop == len(b) else REACH)
            agreed = np.flatnonzero((cuts >= len(head)) & (cuts <= last) & np.isin(cuts, places_b))
            if len(agreed):
                break
            count *= 2
        # Where the tokens and cuts of both sides lie in the window.
        place_a = begin_a[first:] - begin_a[first]
        sides = ((a[first:], place_a, place_a[starts_a[first:]]), (b, begin_b + len(head), places_b))
        ids, starts, at = [a[:first]], [starts_a[:first]], 0
        for letters in pieces[:agreed[0] + 1]:
            own = self._long_piece(letters, at, len(head), *sides) if len(letters) > PIECE else self.piece(letters)
            ids.append(np.asarray(own, np.int64))
            starts.append(np.arange(len(own)) == 0)
            at += len(letters)
        rest = int(np.searchsorted(begin_b + len(head), at))
        return np.concatenate([*ids, b[rest:]]), np.concatenate([*starts, starts_b[rest:]])

    def _long_piece(self, letters, begin, border, left, right):
        """Tokens of a pre-token over the border: those of the left one that begins and of the right one that ends
        with it are kept, but for a window between them.
        """
        end = begin + len(letters)
        (a, place_a, cuts_a), (b, place_b, cuts_b) = left, right
        keep_a, keep_b = a[:0], b[:0]
        if begin in cuts_a:
            after = cuts_a[cuts_a > begin]
            stop = min(end, border, int(after[0]) if len(after) else border)
            keep_a = a[(place_a >= begin) & (place_a + self.lengths[a] <= stop)]
        if end > border and end in cuts_b:
            before = cuts_b[cuts_b < end]
            start = max(begin, int(before[-1]) if len(before) else border)
            keep_b = b[(place_b >= start) & (place_b < end)]
        middle = letters[int(self.lengths[keep_a].sum()):len(letters) - int(self.lengths[keep_b].sum())]
        k = 4
        while True:
            x, y = keep_a[-k:], keep_b[:k]
            found = self.piece(self.spell(x) + middle + self.spell(y))
            if ((len(keep_a) <= k or found[0] == x[0]) and (len(keep_b) <= k or found[-1] == y[-1])):
                return np.concatenate([keep_a[:-k], np.asarray(found, np.int64), keep_b[k:]])
            k *= 2

    def tree(self, nodes: list) -> np.ndarray:
        """Join neighbours, then neighbours of the results, until one encoding is left."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0][0]


def _halves(begin: int, end: int, size: int):
    if end - begin > size:
        middle = (begin + end) // 2
        yield from _halves(begin, middle, size)
        yield from _halves(middle, end, size)
    elif end > begin:
        yield begin, end


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _summary(tool: Codec, ids: np.ndarray, with_ids: bool):
    decoded = tool.decode(ids)
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
            ids.tolist() if with_ids else None, decoded if with_ids else None)


_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def _whole(path, with_ids):
    def rows(batches):
        tool = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [_summary(tool, tool.encode(t.as_py()), with_ids) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(pa.array(c, t) for c, t in zip(zip(*out), _TYPES))], ["row", *_NAMES])

    return rows


def _cut(path):
    def rows(batches):
        tool = codec(path)
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                found = [(key.as_py(), i, *leaf) for i, leaf in enumerate(tool.leaves(text.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                    ["key", "leaf", "stretch", "part"])

    return rows


def _encoded(path):
    def rows(batches):
        tool = codec(path)
        for batch in batches:
            found = [tool.leaf(part.as_py()) for part in batch.column("part")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("key", "leaf", "stretch")),
                 pa.array([ids.astype("<u4").tobytes() for ids, _ in found], pa.binary()),
                 pa.array([starts.tobytes() for _, starts in found], pa.binary())],
                ["key", "leaf", "stretch", "ids", "starts"])

    return rows


def _joined(path, with_ids):
    def rows(batches):
        tool = codec(path)
        for batch in batches:
            for key, leaves in zip(batch.column("key"), batch.column("leaves")):
                order = sorted(leaves.as_py(), key=lambda x: x["leaf"])
                parts = [tool.tree([(np.frombuffer(x["ids"], "<u4").astype(np.int64), np.frombuffer(x["starts"], bool))
                                    for x in group]) for _, group in groupby(order, key=lambda x: x["stretch"])]
                out = _summary(tool, np.concatenate(parts), with_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()], pa.binary()), *(pa.array([c], t) for c, t in zip(out, _TYPES))],
                    ["key", *_NAMES])

    return rows


def encode_decode(df: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again: ``row`` (the columns of ``df``) and ``bpe``.

    ``bpe`` holds ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit numbers), ``decoded_sha256`` and,
    if ``with_ids``, ``ids`` and ``decoded``. Special tokens are not added; their strings inside a text are
    taken as the tokens. A null text counts as empty. Equal long texts are encoded once. No column is
    dropped or renamed inside ``row``, except that without ``with_ids`` the text itself is left out.
    """
    columns = [c for c in df.columns if with_ids or c != text]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.struct().alias("row"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    row_type = packed.schema["row"].dataType.simpleString()
    short = packed.where(F.length("text") < LONG).mapInArrow(_whole(path, with_ids), f"row {row_type}, {_SCHEMA}")
    long = packed.where(F.length("text") >= LONG).select("row", text_key(F.col("text")).alias("key"), "text")
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    leaves = texts.mapInArrow(_cut(path), "key binary, leaf long, stretch long, part string")
    encoded = leaves.repartition("key", "leaf").mapInArrow(
        _encoded(path), "key binary, leaf long, stretch long, ids binary, starts binary")
    joined = checkpointed(encoded.groupBy("key").agg(F.collect_list(F.struct("leaf", "stretch", "ids", "starts"))
                                                     .alias("leaves"))
                          .mapInArrow(_joined(path, with_ids), f"key binary, {_SCHEMA}"))
    long = long.select("row", "key").join(joined, "key").select("row", *_NAMES)
    return short.select("row", F.struct(*_NAMES).alias("bpe")).union(long.select("row", F.struct(*_NAMES).alias("bpe")))


def bpe_report(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``(doc_id, text)``: number of tokens and digests of ids and decoded text."""
    found = encode_decode(docs.select("doc_id", "text"), path, with_ids=False)
    return found.select("row.doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
