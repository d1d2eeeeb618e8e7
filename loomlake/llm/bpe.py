"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch of documents that were not seen before are one linked list of byte pieces, with a
stop between pre-tokens. Every adjacent pair that is in the vocabulary waits in the bucket of its merge
rank, a bucket holding list positions. Which buckets are not empty is kept in a bitmap of two levels, so
the lowest rank is found by two find-first-set steps whatever the number of waiting pairs. A bucket is
merged at once, over all pre-tokens, so a step costs a few array operations; a batch takes about as many
steps as ranks occur in it, whether it holds many short pre-tokens or one very long one. Entries whose
pair changed since they were queued are stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The pairs of tokens that make a token, as sorted keys left * (size + 1) + right with their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        get, keys, made = ranks.get, [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = get(piece[:cut]), get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * (self.size + 1) + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.bytes = np.array([get(bytes([b]), self.size) for b in range(256)], np.int32)
        # a token is plain if all pairs that it is in have higher ranks than its own
        least = np.full(self.size + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, self.keys // (self.size + 1), self.made)
        np.minimum.at(least, self.keys % (self.size + 1), self.made)
        self.plain = (least[:-1] > np.arange(self.size)).tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of token ids, -1 where it makes no token (the stop, id ``size``, never does)."""
        keys = left.astype(np.int64) * (self.size + 1) + right
        at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token: all of it where it is a token, else merged, always the leftmost pair of lowest rank."""
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None:
                rest.append(k)
            else:
                out[k] = np.array([whole], np.int32)
        if rest:
            every, ends = self._merge([words[k] for k in rest])
            for k, ids in zip(rest, np.split(every, ends[:-1])):
                out[k] = ids
        return out

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` and where those of each end.

        ``top`` has bit w set if ``bits[w]`` is not 0, and ``bits[w]`` has bit k set if bucket 64 * w + k
        holds positions. Position 0 and the one after each word are stops.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.append(0, np.cumsum(lens + 1))
        n = int(stops[-1]) + 1
        token = np.full(n, self.size, np.int32)
        inner = np.ones(n, bool)
        inner[stops] = False
        token[inner] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting = np.full(n, -1, np.int32)  # the rank at which the pair that starts here is queued now
        top, bits, buckets = 0, {}, {}

        def queue(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            if len(at) > 1:
                order = ranks.argsort(kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
                firsts, cuts = [0, *cuts], [*cuts, len(at)]
            else:
                firsts, cuts = [0], [1]
            for r, i, j in zip(ranks[firsts].tolist(), firsts, cuts):
                if r in buckets:
                    buckets[r].append(at[i:j])
                    continue
                buckets[r] = [at[i:j]]
                w = r >> 6
                bits[w] = bits.get(w, 0) | 1 << (r & 63)
                top |= 1 << w

        waiting[:-1] = self.rank(token[:-1], token[1:])
        first = np.flatnonzero(waiting >= 0)
        if len(first):
            queue(first, waiting[first])
        while top:
            w = (top & -top).bit_length() - 1
            b = bits[w]
            rank = (w << 6) + (b & -b).bit_length() - 1
            b &= b - 1
            bits[w] = b
            if not b:
                top &= top - 1
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[waiting[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
            if len(at) > 1:
                if self.plain[rank]:
                    # of pairs that overlap, as in a run of one letter, every second one
                    new = np.append(True, after[at[:-1]] != at[1:])
                    if not new.all():
                        place = np.arange(len(at))
                        at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) & 1 == 0]
                else:
                    # what a merge makes may go first: the leftmost pair of each word, the others wait
                    of = stops.searchsorted(at)
                    new = np.append(True, of[1:] != of[:-1])
                    if not new.all():
                        queue(at[~new], waiting[at[~new]])
                        at = at[new]
            gone = after[at]
            to = after[gone]
            after[at] = to
            before[to] = at
            token[at] = rank
            waiting[gone] = -1
            near = np.concatenate((at, before[at]))
            ranks = self.rank(token[near], token[after[near]])
            waiting[near] = ranks
            found = ranks >= 0
            if found.any():
                queue(near[found], ranks[found])
            inner[gone] = False
        # a stop's pair never waits, so what is left of ``inner`` are the starts of the tokens
        return token[inner], np.cumsum(inner)[stops[1:]]


def _ranges(prop: str, last: int) -> str:
    """The inside of a character class with exactly the code points up to ``last`` that ``prop`` matches."""
    spans = []
    for lo, hi in ((0, 0xD7FF), (0xE000, last)):  # no surrogates
        for m in regex.finditer(f"{prop}+", "".join(map(chr, range(lo, hi + 1)))):
            spans.append(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}")
    return "".join(spans)


@lru_cache(8)
def splitter(pattern: str, last: int = 0x10FFFF) -> re.Pattern:
    """``pattern`` for the standard ``re`` module, for texts of code points up to ``last``: property classes and
    white space are written out, so it matches what the pattern means with Unicode properties, and faster."""
    letters, numbers, blank = (_ranges(p, last) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letters}{numbers}]")
    out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(out.replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]"))


class Pieces:
    """Byte strings by id in one array, to join many of them at once."""

    def __init__(self, strings: list[bytes]):
        self.lens = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.every = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not len(ends):
            return b""
        return self.every[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lens), lens)].tobytes()


class Numbers(dict):
    """Numbers strings as they come; ``new`` holds those that were numbered last."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes and decodes whole texts. Ids of pre-tokens are remembered, up to about ``memory`` characters of these."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 2_000_000):
        self.merges, self.memory = Merges(ranks), memory
        self.find_bmp, self.pattern = splitter(pattern, 0xFFFF), pattern
        strings = [b""] * self.merges.size
        for b, i in ranks.items():
            strings[i] = b
        self.pieces, self.decimals = Pieces(strings), Pieces([b"%d " % i for i in range(len(strings))])
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.held = Numbers(), 0
        self.lens, self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self) -> None:
        """Encodes the words numbered last: their ids follow those of the words known before."""
        found = self.merges.encode([w.encode() for w in self.numbers.new])
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lens) - lens)
        self.lens = np.append(self.lens, lens)
        self.ids = np.concatenate((self.ids, *found))
        self.held += sum(map(len, self.numbers.new))
        self.numbers.new = []

    def _split(self, text: str) -> np.ndarray:
        """The numbers of the matches of the pattern in ``text``."""
        wide = len(text.encode("utf-16-le")) != 2 * len(text)
        find = splitter(self.pattern) if wide else self.find_bmp
        words = find.findall(text) if len(text) < 1 << 22 else (m[0] for m in find.finditer(text))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32)

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text, each match of the pattern encoded on its own, without special tokens."""
        if self.held > self.memory:
            self._forget()
        split = [self._split(t) for t in texts]
        if self.numbers.new:
            self._learn()
        out = []
        for words in split:
            lens = self.lens[words]
            ends = np.cumsum(lens)
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(self.starts[words] - (ends - lens), lens)] if len(ends) else np.empty(0, np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pieces.join(ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by one space."""
        return self.decimals.join(ids)[:-1]


@lru_cache(2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a worker process, kept over its tasks."""
    return Encoder(parse_ranks(ranks), pattern)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, size: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), a slice ending after about ``size`` bytes of text."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
            part = batch.slice(at, upto - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = upto


def vocabulary(path: str) -> bytes:
    """The rank file as bytes, to be broadcast: its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the array ``token_ids``.

    Whole texts are encoded without special tokens and decoded again. A null text counts as empty
    (no tokens, the hashes of nothing). Repeated rows and null ids are kept; other columns are ignored.
    No shuffle: one pass over two columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for part, texts in text_batches(batches, 1):
            every = enc.encode_all(texts)
            a = [hashlib.sha256(enc.decimal(found)).hexdigest() for found in every]
            b = [hashlib.sha256(enc.decode(found)).hexdigest() for found in every]
            out = {id_col: part.column(0), "n_tokens": pa.array([len(x) for x in every], pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if ids:
                ends = np.cumsum([0, *map(len, every)], dtype=np.int32)
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every)))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Ids back to text: (id, text). Null or empty ids give an empty text; bytes that aren't UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(shared.value)
        strings = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            strings[i] = piece
        pieces = Pieces(strings)
        for batch in batches:
            texts = [pieces.join(np.array(ids or [], np.int64)).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "text": pa.array(texts, pa.string())})

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, text string")
