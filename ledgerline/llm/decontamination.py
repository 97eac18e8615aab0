"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased; runs of characters other than letters and digits become
one space (non-ASCII characters are kept). Every benchmark item is searched
through segments: a whole item of up to ``SEGMENT`` normalised bytes, or
overlapping segments of that length. A segment of m bytes may be met with
``e = floor(EDITS * m)`` edits. By the q-gram lemma such an occurrence shares
at least ``m + 1 - Q * (e + 1)`` q-grams with it, all within e diagonals of
each other, so the hits of a document are counted in overlapping diagonal
bands of width 2(e + 1), step e + 1; only bands reaching the threshold are kept, and verified by a banded
alignment of the segment against the
band's part of the document.

A quote of part of an item may cover no segment. So any verbatim run of at least
``VERBATIM`` normalised bytes of an item, wherever it lies in the item, is found
as well: q-gram hits at consecutive places of document and item. Shorter
parts of an item, and parts with edits that cover no segment, are not found.

A row is returned per (document, item) with at least one verified segment or run.
Segments of fewer than ``MIN_BYTES`` bytes carry no evidence: such items, like
null and empty ones, never match. Null and empty texts match nothing. Repeated
rows are each searched.

The benchmark is the stated query set. Its segments are sent to the executors
in blocks of at most ``BLOCK_BYTES``; every block is searched over all rows. A
block that starts inside an item repeats the segment before, so that every two
neighbours, which hold every run of ``VERBATIM`` bytes, are in one block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import PrefixHash, one_model

Q, SEGMENT, EDITS, MIN_BYTES = 8, 120, 0.1, 32
VERBATIM = 80               # at most SEGMENT
BLOCK_BYTES = 8 << 20
_PIECE = 4 << 20            # bytes of a document searched at once
_BITS = 22

_CLASS = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c >= 128:
        _CLASS[_c] = _c


def normalise(text: str | None) -> np.ndarray:
    """Normalised UTF-8 bytes."""
    if not text:
        return np.zeros(0, np.uint8)
    data = _CLASS[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    space = data == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = data[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def budget(m: int) -> int:
    """Edits allowed in m bytes; fewer where the lemma would leave no q-gram."""
    return min(int(EDITS * m), (m - Q) // Q)


def segments(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset, bytes): overlapping by half, the last one flush with the end."""
    if len(data) < MIN_BYTES:
        return []
    last = max(0, len(data) - SEGMENT)
    starts = [*range(0, last, SEGMENT // 2), last]
    return [(s, data[s: s + SEGMENT]) for s in starts]


def align(pattern: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of ``pattern`` in ``region``
    with free ends of the region, edits = limit + 1 if there is none within it.

    Semi-global alignment row by row; insertions along a row are a running
    minimum. The region is the band: it holds only the diagonals in question.
    """
    n = len(region)
    cols = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), cols.copy()
    for i, c in enumerate(pattern.tolist(), 1):
        diag = cost[:-1] + (region != c)
        up = cost + 1
        take = np.concatenate(([False], diag < up[1:]))
        new = np.where(take, np.concatenate(([0], diag)), up)
        frm = np.where(take, np.concatenate(([0], start[:-1])), start)
        key = (new - cols) * (n + 2) + frm                    # a cheaper cell to the left, with its start
        best = np.minimum.accumulate(key)
        cost = best // (n + 2) + cols
        start = best % (n + 2)
        if cost.min() > limit:
            return limit + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Searcher:
    """Index of the q-grams of one block of segments."""

    def __init__(self, block: list[tuple[int, int, bytes]]):
        """block: (item number, offset in the item, segment)."""
        self.item = np.array([b[0] for b in block], np.int64)
        self.offset = np.array([b[1] for b in block], np.int64)
        same = (self.item[1:] == self.item[:-1]) & (self.offset[1:] > self.offset[:-1])
        self.row = np.cumsum(np.concatenate(([True], ~same))) - 1      # texts of one item number are kept apart
        self.bytes = [np.frombuffer(b[2], np.uint8) for b in block]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.edits = np.array([budget(len(b)) for b in self.bytes], np.int64)
        self.need = self.size + 1 - Q * (self.edits + 1)
        grams = [PrefixHash(b).windows(Q) for b in self.bytes]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.at = grams[order], owner[order], at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of the best verified segment of
        each item, or of its first verbatim run if no segment is met; start and
        end are offsets in the normalised text."""
        data = normalise(text)
        overlap = 2 * SEGMENT + 4 * (int(EDITS * SEGMENT) + 1)
        best: dict[int, tuple[int, int, int]] = {}
        runs: dict[int, tuple[int, int, int]] = {}
        for begin in range(0, max(1, len(data)), _PIECE):
            piece = data[begin: begin + _PIECE + overlap]
            hits = self._hits(piece)
            if hits is None:
                continue
            for item, edits, s, e in self._search(piece, *hits):
                if item not in best or (edits, begin + s) < best[item][:2]:
                    best[item] = (edits, begin + s, begin + e)
            for item, s, e in self._runs(piece, *hits):
                runs.setdefault(item, (0, begin + s, begin + e))
        best = runs | best
        return [(item, *best[item]) for item in sorted(best)]

    def _hits(self, data: np.ndarray):
        """All (position, segment, offset) of common q-grams, by position."""
        if len(data) < MIN_BYTES - int(EDITS * MIN_BYTES):
            return None
        hashes = PrefixHash(data).windows(Q)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.grams, hashes[maybe], "left")
        high = np.searchsorted(self.grams, hashes[maybe], "right")
        times = high - low
        if not times.sum():
            return None
        pos = np.repeat(maybe, times)
        hit = np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        return pos, self.owner[hit], self.at[hit]

    def _runs(self, data: np.ndarray, pos, seg, off):
        """(item number, start, end) of the verbatim runs of at least VERBATIM bytes, by start."""
        long = VERBATIM - Q + 1                                 # q-grams of such a run
        new = np.diff(pos, prepend=-2)                          # 0: another hit of the position, 1: of the next one
        stretch = np.cumsum(new > 1) - 1
        places = np.bincount(stretch, new > 0)
        keep = (places >= long)[stretch]
        if not keep.any():
            return
        pos, seg, off = pos[keep], seg[keep], off[keep]
        row, at = self.row[seg], self.offset[seg] + off
        order = np.lexsort((seg, pos, at - pos, row))
        pos, seg, off, row, diag = pos[order], seg[order], off[order], row[order], (at - pos)[order]
        fresh = np.ones(len(pos), bool)                         # a q-gram may lie in two segments
        fresh[1:] = (row[1:] != row[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] != pos[:-1])
        pos, seg, off, row, diag = pos[fresh], seg[fresh], off[fresh], row[fresh], diag[fresh]
        starts = np.ones(len(pos), bool)
        starts[1:] = (row[1:] != row[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(starts)
        size = np.diff(first, append=len(pos))
        first, size = first[size >= long], size[size >= long]
        for k in np.argsort(pos[first], kind="stable"):
            f, n = int(first[k]), int(size[k])
            grams = range(f, f + n)
            if all(data[pos[g]: pos[g] + Q].tobytes() == self.bytes[seg[g]][off[g]: off[g] + Q].tobytes() for g in grams):
                yield int(self.item[seg[f]]), int(pos[f]), int(pos[f]) + n + Q - 1

    def _search(self, data: np.ndarray, pos, seg, off):
        step = self.edits[seg] + 1
        diag = pos - off                                        # where the segment would start
        # at most e insertions and deletions: the hits of an occurrence span at most e + 1 diagonals, and those
        # lie together in one of the bands [k * step, (k + 2) * step)
        band = np.floor_divide(diag, step)
        seg2, band2 = np.concatenate([seg, seg]), np.concatenate([band, band - 1])
        off2 = np.concatenate([off, off])
        order = np.lexsort((off2, band2, seg2))
        seg2, band2, off2 = seg2[order], band2[order], off2[order]
        new = np.ones(len(seg2), bool)
        new[1:] = (seg2[1:] != seg2[:-1]) | (band2[1:] != band2[:-1])
        fresh = new.copy()                                      # each q-gram of the segment counts once in a band
        fresh[1:] |= off2[1:] != off2[:-1]
        group = np.cumsum(new) - 1
        counts = np.bincount(group, fresh)
        first = np.flatnonzero(new)
        for g in np.flatnonzero(counts >= self.need[seg2[first]]):
            s, b = int(seg2[first[g]]), int(band2[first[g]])
            e = int(self.edits[s])
            lo = max(0, b * (e + 1) - e)
            hi = min(len(data), (b + 2) * (e + 1) + int(self.size[s]) + e)
            pattern, region = self.bytes[s], data[lo:hi]
            exact = region.tobytes().find(pattern.tobytes())
            if exact >= 0:
                yield int(self.item[s]), 0, lo + exact, lo + exact + len(pattern)
                continue
            edits, start, end = align(pattern, region, e)
            if edits <= e:
                yield int(self.item[s]), edits, lo + start, lo + end


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of (item id, offset, segment), read from the table in a stream."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        for offset, piece in segments(normalise(r["t"])):
            if held >= BLOCK_BYTES:
                yield block
                block = block[-1:] if offset else []
                held = sum(len(b[2]) for b in block)
            block.append((r["i"], offset, piece.tobytes()))
            held += len(piece)
    if block:
        yield block


def _matcher(sent, key: int):
    @F.pandas_udf("array<struct<item:bigint,edits:int,start:bigint,end:bigint>>")
    def match(text):
        import pandas as pd

        from ledgerline.llm import decontamination as module

        find = module.one_model("decontamination", key, lambda: module.Searcher(sent.value)).search
        return pd.Series([[{"item": i, "edits": e, "start": s, "end": t} for i, e, s, t in find(x)]
                          for x in text.where(text.notna(), None)])

    return match


def matchers(benchmark: DataFrame, item_col="item_id", text_col="text") -> list:
    """A column function text -> array of matches for each block."""
    spark, out = benchmark.sparkSession, []
    for block in _blocks(benchmark, item_col, text_col):
        out.append(_matcher(spark.sparkContext.broadcast(block), hash(tuple(block))))
    return out


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, item_id, edits, start, end: a row per document and item found."""
    found = None
    for match in matchers(benchmark):
        part = (df.select(F.col(id_col), F.explode(match(F.col(text_col))).alias("m"))
                .select(id_col, F.col("m.item").alias("item_id"), "m.edits", "m.start", "m.end"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"{id_col} long, item_id long, edits int, start long, end long")
    # an item whose segments fall into two blocks is reported once
    return found.groupBy(id_col, "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("m")).select(
        id_col, "item_id", "m.edits", "m.start", "m.end")


def clean(df: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows of ``df`` in which no item is found, all columns as they are."""
    for match in matchers(benchmark):
        df = df.where(F.size(match(F.col(text_col))) == 0)
    return df
