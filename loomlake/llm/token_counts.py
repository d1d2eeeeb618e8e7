"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. The byte lengths of its tokens give each token's span of
characters; these spans are interval-joined to the sections' spans (both are sorted, so two binary
searches over arrays do it), and a token that crosses a boundary goes where the rule says.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlake.llm.bpe import encoder, text_batches, vocabulary

RULES = ("start", "end", "majority")


def token_spans(data: bytes, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token; a token of part of a character belongs to that character."""
    ends = np.cumsum(lens)
    if len(ends) and ends[-1] == len(data) and not data.isascii():
        place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        return place[ends - lens], place[ends - 1]
    return ends - lens, ends - 1


def flat(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (starts, ends, section) without overlap: each character belongs to the section around it that starts last."""
    if not (starts[1:] < ends[:-1]).any():
        return starts, ends, np.arange(len(starts))
    cuts, open_, k, out = np.unique(np.concatenate((starts, ends))).tolist(), [], 0, []
    for a, z in zip(cuts, cuts[1:]):
        while k < len(starts) and starts[k] <= a:
            heappush(open_, (-k, int(ends[k])))
            k += 1
        while open_ and open_[0][1] <= a:
            heappop(open_)
        if open_:
            out.append((a, z, -open_[0][0]))
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, section: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, -1 for none, and whether the token crosses a boundary. Stretches are sorted and do not overlap."""
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)

    def holding(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, "right") - 1
        return np.where((k >= 0) & (at < ends[k]), k, -1)

    a, z = holding(first), holding(last)
    crossing = (a != z) | (a < 0) & (np.searchsorted(starts, last, "right") > np.searchsorted(ends, first, "right"))
    name = np.append(section, -1)  # of stretch -1
    if rule == "end":
        return name[z], crossing
    out = name[a]
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            share: dict[int, int] = {}
            for k in range(np.searchsorted(ends, first[t], "right"), np.searchsorted(starts, last[t], "right")):
                share[section[k]] = share.get(section[k], 0) + int(min(ends[k], last[t] + 1) - max(starts[k], first[t]))
            out[t] = max(share, key=lambda k: (share[k], -k)) if share else -1
    return out, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections; a line feed belongs to the line that it ends. An empty text has none."""
    lens = np.array([len(x) + 1 for x in text.split("\n")])
    lens[-1] -= 1
    ends = np.cumsum(lens)
    keep = lens > 0
    return (ends - lens)[keep], ends[keep]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """One row per section: id, section, char_start, char_end, n_tokens, n_crossing.

    Sections are the lines of the text, or those of ``sections_col``, an array of (start, end) characters, numbered
    by start and end. A null array has none, and null sections, null bounds and sections without a character are
    left out. Where sections overlap, a character belongs to the one that starts last, of equal starts the one that
    ends last. A token inside one section counts there. One that crosses a boundary counts once, by
    ``rule``: "start" where its first character lies, "end" where its last one lies, "majority" where most
    of its characters lie (the earlier section on a tie); ``n_crossing`` says how many of a section's
    tokens are such. Tokens in no section are in a row of section -1 (null bounds), so the counts of a
    document always sum to its tokens. A null or empty text gives one row of section -1 with 0 tokens.
    Repeated rows each give their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    if sections_col:
        start, end = docs.schema[sections_col].dataType.elementType.names[:2]
        cols.append(F.array_sort(F.transform(F.col(f"`{sections_col}`"), lambda s: F.struct(s[start].cast("long").alias("a"), s[end].cast("long").alias("z")))).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for part, texts in text_batches(batches, 1):
            given = part.column(2).to_pylist() if sections_col else [None] * part.num_rows
            take, parts = [], []
            for row, (text, ids, own) in enumerate(zip(texts, enc.encode_all(texts), given)):
                if sections_col:
                    spans = np.array([(s["a"], s["z"]) for s in own or () if s and s["a"] is not None and s["z"] is not None and s["a"] < s["z"]], np.int64).reshape(-1, 2)
                    starts, ends = spans[:, 0], spans[:, 1]
                else:
                    starts, ends = line_sections(text)
                to, crosses = attribute(*token_spans(text.encode(), enc.pieces.lens[ids]), *flat(starts, ends), rule)
                k = len(starts)
                n, crossing = (np.bincount(x + 1, minlength=k + 1) for x in (to, to[crosses]))
                lo = 0 if n[0] or not k else 1
                take += [row] * (k + 1 - lo)
                parts.append(np.stack([np.arange(-1, k), np.append(-1, starts), np.append(-1, ends), n, crossing])[:, lo:])
            if parts:
                every = np.concatenate(parts, 1)
                none = every[0] < 0
                yield pa.RecordBatch.from_pydict({id_col: part.column(0).take(pa.array(take, pa.int64())), "section": pa.array(every[0]), "char_start": pa.array(every[1], mask=none), "char_end": pa.array(every[2], mask=none), "n_tokens": pa.array(every[3]), "n_crossing": pa.array(every[4])})

    return docs.select(*cols).mapInArrow(run, f"`{id_col}` {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")
