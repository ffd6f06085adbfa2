"""Problem 8: byte-pair encoding of whole texts by padded matrices.

A text is split by the tokenizer's pattern; every different piece of a batch is
encoded once. Pieces are bucketed by length into padded matrices of token ids.
In each round every row merges its leftmost pair of minimum rank: the ranks of
all pairs come from an open-addressing hash table, two of them are looked up
again after a merge, and rows without a mergeable pair leave the matrix. Rows
longer than LONG merge all disjoint occurrences of their minimum-rank pair in one
round, which gives the same ids because a merged token only forms pairs of
higher rank than its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
LONG = 256
CELLS = 2_000_000  # of one matrix
CHARS = 4_000_000  # of text encoded at a time
REMEMBER = 300_000  # pieces kept between batches
_BITS = 18
_EDGES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """The ids of single bytes, and the hash table (left << 32 | right) -> rank of the merged token."""
    keys, values = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(rank)
    size = 1 << _BITS
    while size < 2 * len(keys):
        size *= 2
    slots, found = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
    todo_k, todo_v = np.array(keys, np.int64), np.array(values, np.int32)
    at = _hash(todo_k, size)
    while len(todo_k):
        free = slots[at] < 0
        order = np.flatnonzero(free)
        _, first = np.unique(at[order], return_index=True)
        win = order[first]
        slots[at[win]], found[at[win]] = todo_k[win], todo_v[win]
        left = np.ones(len(todo_k), bool)
        left[win] = False
        todo_k, todo_v, at = todo_k[left], todo_v[left], (at[left] + 1) & (size - 1)
    return {"bytes": np.array([ranks[bytes([b])] for b in range(256)], np.int32), "slots": slots, "found": found}


def _hash(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _ranks(table: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of each pair, NONE where it can't merge or a side is missing (-1)."""
    keys = left.astype(np.int64) << 32 | right.astype(np.int64)
    slots, found = table["slots"], table["found"]
    size = len(slots)
    at = _hash(keys, size)
    out = np.where(slots[at] == keys, found[at], NONE)
    open_ = np.flatnonzero((slots[at] != keys) & (slots[at] >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & (size - 1)
        here = slots[at[open_]]
        hit = here == keys[open_]
        out[open_[hit]] = found[at[open_[hit]]]
        open_ = open_[~hit & (here >= 0)]
    out[(left < 0) | (right < 0)] = NONE
    return out


def _pairs(table, ids: np.ndarray) -> np.ndarray:
    return _ranks(table, ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)


def _merge_rows(table, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodes the rows of a padded matrix; returns the padded result and its lengths."""
    done, done_len = ids.copy(), lengths.copy()
    rows, width = np.arange(len(ids)), ids.shape[1]
    if width < 2:
        return done, done_len
    ids, left = ids.copy(), lengths.copy()
    rank = _pairs(table, ids)
    while len(rows):
        at = rank.argmin(1)
        each = np.arange(len(rows))
        best = rank[each, at]
        ended = best == NONE
        if ended.any():
            done[rows[ended], : ids.shape[1]] = ids[ended]
            done_len[rows[ended]] = left[ended]
            keep = ~ended
            rows, ids, rank, left, at, best = rows[keep], ids[keep], rank[keep], left[keep], at[keep], best[keep]
            if not len(rows):
                break
            each = np.arange(len(rows))
            used = int(left.max())
            ids, rank = ids[:, :used], rank[:, : used - 1]
        ids[each, at] = best
        span = ids.shape[1]
        source = np.arange(span)[None, :]
        ids = np.take_along_axis(np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], 1), source + (source > at[:, None]), 1)
        source = np.arange(span - 1)[None, :]
        rank = np.take_along_axis(np.concatenate([rank, np.full((len(rank), 1), NONE, np.int32)], 1), source + (source > at[:, None]), 1)
        left = left - 1
        after = np.minimum(at, span - 2)
        rank[each, after] = np.where(at <= span - 2, _ranks(table, ids[each, after], ids[each, after + 1]), rank[each, after])
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = _ranks(table, ids[before, at[before] - 1], ids[before, at[before]])
    return done, done_len


def _merge_long(table, ids: np.ndarray) -> np.ndarray:
    """Encodes one long row."""
    while len(ids) > 1:
        rank = _ranks(table, ids[:-1], ids[1:])
        best = rank.min()
        if best == NONE:
            break
        hits = np.flatnonzero(rank == best)
        gap = np.diff(hits, prepend=-2) > 1  # in a run of overlapping pairs every second one merges
        run = np.maximum.accumulate(np.where(gap, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        ids[hits] = best
        keep = np.ones(len(ids), bool)
        keep[hits + 1] = False
        ids = ids[keep]
    return ids


def encode_pieces(table: dict[str, np.ndarray], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in order, number of ids of each piece)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = table["bytes"][np.frombuffer(b"".join(pieces), np.uint8)]
    starts = np.cumsum(lengths) - lengths
    counts = np.zeros(len(pieces), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for edge in _EDGES:
        bucket = np.flatnonzero((lengths > low) & (lengths <= edge))
        low = edge
        for rows in np.split(bucket, range(CELLS // edge, len(bucket), max(1, CELLS // edge))) if len(bucket) else ():
            column = np.arange(edge)[None, :]
            real = column < lengths[rows][:, None]
            ids = np.where(real, flat[np.minimum(starts[rows][:, None] + column, len(flat) - 1)], np.int32(-1))
            out, n = _merge_rows(table, ids, lengths[rows])
            counts[rows] = n
            parts.append((rows, out[column < n[:, None]], n))
    for row in np.flatnonzero(lengths > LONG):
        out = _merge_long(table, flat[starts[row] : starts[row] + lengths[row]].copy())
        counts[row] = len(out)
        parts.append((np.array([row]), out, np.array([len(out)])))
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for rows, values, n in parts:
        ids[_ranges(ends[rows] - n, n)] = values
    return ids, counts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges [start, start + length)."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Encodes lists of texts, remembering the pieces it has met."""

    def __init__(self, table: dict[str, np.ndarray], pattern: str):
        import regex

        self.table, self.split = table, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text); NULL and empty texts have none."""
        if len(self.known) > REMEMBER:
            self.forget()
        known, fresh, codes, sizes = self.known, [], [], []
        for text in texts:
            pieces = self.split(text) if text else ()
            sizes.append(len(pieces))
            for p in pieces:
                code = known.get(p)
                if code is None:
                    code = known[p] = len(known)
                    fresh.append(p.encode("utf-8"))
                codes.append(code)
        if fresh:
            ids, counts = encode_pieces(self.table, fresh)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        code = np.array(codes, np.int64)
        lengths = self.counts[code]
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        return self.ids[_ranges(self.starts[code], lengths)], np.diff(total[bounds])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


def _run(df: DataFrame, doc_id: str, text: str, vocabulary: str, pattern: str, whole: bool) -> DataFrame:
    table = df.sparkSession.sparkContext.broadcast(pair_table(load_ranks(vocabulary)))  # bounded by the vocabulary
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                ids, counts = encoder.encode(texts[a:b])
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids)) if whole else pa.array(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], out], names=["doc_id", "ids" if whole else "n_tokens"])

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, " + ("ids array<int>" if whole else "n_tokens long"))


def encode_texts(df: DataFrame, doc_id: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text without special tokens.

    NULL and empty texts have the empty list. The strings of special tokens in a
    text are ordinary text. Rows repeated under one id stay. No shuffle.
    """
    return _run(df, doc_id, text, vocabulary, pattern, True)


def count_tokens(df: DataFrame, doc_id: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row, 0 for NULL and empty texts."""
    return _run(df, doc_id, text, vocabulary, pattern, False)


def check_round_trip(df: DataFrame, ids: str, text: str, vocabulary: str) -> DataFrame:
    """One row: n_documents, and n_equal, those whose ids decode to the text (NULL counts as empty)."""
    tokens = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(vocabulary).items()})  # bounded by the vocabulary

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = tokens.value
        for batch in batches:
            same = [b"".join([back[i] for i in row]) == (t or "").encode() for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([len(same)], pa.int64()), pa.array([sum(same)], pa.int64())], names=["n", "same"])

    return df.select(ids, text).mapInArrow(compare, "n long, same long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_equal"))
