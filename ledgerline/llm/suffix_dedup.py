"""Exact substring dedup through run-length compressed suffix indexes.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (same document included, overlaps count) is removed. Strings are judged on
the input; they never cross documents.

Windows are dealt out by content. Of the k-mers in a window of ``length`` bytes
the one with the smallest hash is its anchor, so equal windows have the same
anchor at the same offset. Consecutive windows with one anchor form a cell
(about one per 80 bytes). Then
* an anchor k-mer that occurs once has no repeated window;
* cells of equal bytes repeat all their windows;
* the remaining cells share only their anchor with others: their distinct byte
  strings go into buckets by anchor, of bounded size. A bucket is indexed by a
  Burrows-Wheeler transform kept as runs. Where two neighbouring rows of the
  suffix order have the same preceding byte, the longest common prefix of a text
  position follows from that of the position after it; only the first and last
  row of every run needs a sample that is computed. Streaming through the text
  from sample to sample gives the longest match of every position with any other
  one, and matches of ``length`` or more mark a window.
An anchor with more distinct cells than one bucket may hold (a phrase with ever
other surroundings) is not gathered: its windows are counted one by one by hash.

Cells and windows are compared by 128 bits (anchor and cell hash).

Null and empty texts and texts shorter than ``length`` lose nothing. Rows that
are equal in id and text are documents of their own, so such copies lose all
bytes if they are long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import PrefixHash, save

LENGTH, KMER = 200, 40
_PIECE = 4 << 20                 # windows of a document handled at once
BUCKET_BYTES = 3 << 20
INDEX_BYTES = 1 << 20            # text of one index; a bucket is indexed in parts of whole anchors
GROUP_CELLS = 10_000             # distinct cells of one anchor that go into a bucket


def cells(data: np.ndarray, length: int = LENGTH, kmer: int = KMER):
    """(first window, last window, anchor position, anchor hash, cell hash) of
    all cells of a byte string."""
    span = length - kmer + 1
    parts = []
    for begin in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[begin: begin + _PIECE + length - 1]
        prefix = PrefixHash(piece)
        hashes = prefix.windows(kmer)
        m = len(hashes)
        # 40 bits of hash, then position: the minimum is the leftmost smallest
        key = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // span)
        grid = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:m] = key
        grid = grid.reshape(rows, span)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - span + 1
        least = np.minimum(after[:windows], before[span - 1: span - 1 + windows])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = anchor[first]
        parts.append((first + begin, last + begin, at + begin, hashes[at], prefix.of(first, last + length)))
    if not parts:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*parts)]


def suffix_order(text: np.ndarray, longest: int):
    """(suffix array, ranks by prefix length): prefix doubling until prefixes
    of ``longest`` symbols are told apart. ``text`` holds small integers."""
    bits = max(1, int(text.max()).bit_length())
    width = max(1, min(62 // bits, longest))
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key = np.zeros(len(text), np.int64)
    for i in range(width):
        key = (key << bits) | padded[i: i + len(text)]
    levels = []
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(len(text), np.int32)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        levels.append((width, rank))
        if width >= longest or rank.max() == len(text) - 1:
            return order, levels
        beyond = np.concatenate([rank[width:], np.full(min(width, len(text)), -1, np.int32)])
        key = (rank.astype(np.int64) << 32) | (beyond + 1).astype(np.int64)
        width *= 2


def _common(a: np.ndarray, b: np.ndarray, levels) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b."""
    n = len(levels[0][1])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = levels[k]
        for _ in range(62 if k == 0 else 1):              # the shortest level may be used again and again
            x, y = a + out, b + out
            inside = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[inside] = rank[x[inside]] == rank[y[inside]]
            if not same.any():
                break
            out[same] += width
    return out


def matching_statistics(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(longest match of every position with another one, start of every
    string, runs). Matches stay inside a string."""
    sizes = np.array([len(s) for s in strings])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = starts + sizes
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + len(strings)
    text[ends] = np.arange(len(strings))                  # a separator of its own behind every string
    order, levels = suffix_order(text, int(sizes.max()) + 1)
    n = len(text)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    last_symbol = text[order - 1]                         # the transform (position -1: the last one)
    border = last_symbol[1:] != last_symbol[:-1]
    best = np.zeros(n, np.int64)
    for heads, neighbour in ((np.concatenate(([True], border)), -1), (np.concatenate((border, [True])), 1)):
        sample = (order[heads] - 1) % n                   # positions whose value does not follow from the next one
        other = where[sample] + neighbour
        inside = (other >= 0) & (other < n)
        value = np.zeros(len(sample), np.int64)
        value[inside] = _exact_common(text, sample[inside], order[other[inside]], levels)
        at = np.full(n, n, np.int64)
        at[sample] = sample
        at = np.minimum.accumulate(at[::-1])[::-1]        # next sampled position
        known = np.zeros(n + 1, np.int64)
        known[sample] = value
        stream = np.where(at < n, known[np.minimum(at, n)] + (at - np.arange(n)), 0)
        np.maximum(best, stream, out=best)
    return best, starts, int(border.sum()) + 1


def _exact_common(text, a, b, levels):
    """Common prefix length: by ranks, then symbol by symbol below the shortest level."""
    out = _common(a, b, levels)
    n = len(text)
    live = np.arange(len(a))
    for _ in range(levels[0][0]):
        x, y = a[live] + out[live], b[live] + out[live]
        good = (x < n) & (y < n)
        good[good] = text[x[good]] == text[y[good]]
        live = live[good]
        if not len(live):
            break
        out[live] += 1
    return out


def _runs(flags: np.ndarray):
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _whole_anchors(g: np.ndarray, sizes: np.ndarray) -> list[slice]:
    """Runs of rows of about INDEX_BYTES together that divide no anchor (``g`` is
    sorted). Equal windows have equal anchors, so no match lies across two runs."""
    edges = np.concatenate((np.flatnonzero(np.diff(g, prepend=~g[:1])), [len(g)]))
    before = np.concatenate(([0], np.cumsum(sizes)))
    out, start = [], 0
    for end in edges[1:].tolist():
        if before[end] - before[start] >= INDEX_BYTES or end == len(g):
            out.append(slice(start, end))
            start = end
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, t: name of a document (equal rows share it); body: its bytes."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"),
                     F.xxhash64(F.col(id_col).isNull(), body).alias("t"), body.alias("body"))


def _cell_rows(length: int, kmer: int, full: bool):
    def rows(batches):
        import pandas as pd

        for pdf in batches:
            held = {c: [] for c in ("k", "t", "at", "g", "c")}
            for k, t, body in zip(pdf["k"], pdf["t"], pdf["body"]) if full else ((0, 0, b) for b in pdf["body"]):
                if len(body) < length:
                    continue
                first, last, _, g, c = cells(np.frombuffer(body, np.uint8), length, kmer)
                held["g"].append(g.view(np.int64))
                if full:
                    held["k"].append(np.full(len(g), k))
                    held["t"].append(np.full(len(g), t))
                    held["at"].append((first << 16) | (last - first))
                    held["c"].append(c.view(np.int64))
            if held["g"]:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in held.items() if v})

    return rows


def repeated_spans(df: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, kmer=KMER,
                   group_cells=GROUP_CELLS, bucket_bytes=BUCKET_BYTES) -> DataFrame:
    """(k, t, spans): byte ranges [start, end) to remove per document name."""
    spark = df.sparkSession
    docs = _keyed(df, id_col, text_col).where(F.octet_length("body") >= length)
    anchors = docs.select("body").mapInPandas(_cell_rows(length, kmer, False), "g long")
    shared = save(anchors.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "anchors")
    found = docs.select("k", "t", "body").mapInPandas(_cell_rows(length, kmer, True), "k long, t long, at long, g long, c long")
    found = save(found.join(shared, "g"), "cells")
    kinds = save(found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "at")).alias("one")), "kinds")
    mixed = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    mixed = save(mixed.select("g", "kinds"), "mixed")
    unsure = save(kinds.select("g", "c", "n", "one.k", "one.t", "one.at").join(mixed, "g"), "unsure")

    # the bytes of one cell of each kind
    asked = save(unsure.groupBy("k", "t").agg(F.collect_list(F.struct(
        "at", "g", (F.col("n") == 1).alias("single"), (F.col("kinds") > group_cells).alias("crowd"))).alias("asked")), "asked")
    bodies = docs.select("k", "t", "body").join(asked, ["k", "t"])

    def cut(batches):
        import pandas as pd

        done = set()                                          # equal rows meet here: one of them is enough
        for pdf in batches:
            rows = []
            for k, t, body, wanted in zip(pdf["k"], pdf["t"], pdf["body"], pdf["asked"]):
                if (k, t) in done:
                    continue
                done.add((k, t))
                for w in wanted:
                    first, more = w["at"] >> 16, w["at"] & 0xFFFF
                    rows.append((k, t, w["at"], w["g"], w["single"], w["crowd"], body[first: first + more + length]))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["k", "t", "at", "g", "single", "crowd", "bytes"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["k", "t", "at", "g", "single", "crowd", "bytes"])

    cut_rows = save(bodies.mapInPandas(cut, "k long, t long, at long, g long, single boolean, crowd boolean, bytes binary"), "bytes")

    size = cut_rows.where("not crowd").agg(F.sum(F.octet_length("bytes"))).collect()[0][0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def index(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["k", "t", "at"]).sort_values(["g", "k", "t", "at"])
        rows = []
        for part in _whole_anchors(pdf["g"].to_numpy(), pdf["bytes"].str.len().to_numpy()):
            some = pdf.iloc[part]
            best, starts, _ = matching_statistics(some["bytes"].tolist())
            for k, t, at, single, s in zip(some["k"], some["t"], some["at"], some["single"], starts.tolist()):
                if single:
                    first, more = at >> 16, at & 0xFFFF
                    for lo, hi in zip(*_runs(best[s: s + more + 1] >= length)):
                        rows.append((k, t, first + lo, first + hi - 1 + length))
        return pd.DataFrame(rows, columns=["k", "t", "lo", "hi"])

    span = "k long, t long, lo long, hi long"
    bucketed = cut_rows.where("not crowd").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    partly = bucketed.groupBy("bucket").applyInPandas(index, span)

    # anchors with too many kinds of cells: window by window
    def single_windows(batches):
        import pandas as pd

        for pdf in batches:
            parts = []
            for k, t, at, g, single, body in zip(*(pdf[c] for c in ("k", "t", "at", "g", "single", "bytes"))):
                data = np.frombuffer(body, np.uint8)
                h = PrefixHash(data).windows(length)
                parts.append(pd.DataFrame({"k": k, "t": t, "lo": (at >> 16) + np.arange(len(h)), "g": g, "h": h.view(np.int64),
                                           "n": 1 if single else 2}))
            if parts:
                yield pd.concat(parts)

    crowd = cut_rows.where("crowd").dropDuplicates(["k", "t", "at"]).mapInPandas(
        single_windows, "k long, t long, lo long, g long, h long, n int")
    if not mixed.where(F.col("kinds") > group_cells).isEmpty():
        crowd = save(crowd, "windows")
        again = save(crowd.groupBy("g", "h").agg(F.sum("n").alias("m")).where("m > 1").select("g", "h"), "again")
        partly = partly.unionAll(crowd.join(again, ["g", "h"]).select("k", "t", "lo", (F.col("lo") + length).alias("hi")))
    partly = save(partly, "partly")

    first, more = F.shiftright("at", 16), F.col("at").bitwiseAND(0xFFFF)
    whole = (found.join(kinds.where("n > 1").select("g", "c"), ["g", "c"])
             .select("k", "t", first.alias("lo"), (first + more + length).alias("hi")))
    spans = whole.unionAll(partly).groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return save(spans, "spans")


def merge(spans) -> list[tuple[int, int]]:
    """Sorted ranges; overlapping and touching ones are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, **options) -> DataFrame:
    """id, n_bytes, spans (maximal removed ranges), kept (remaining bytes) and
    its sha256 for every row."""
    spans = repeated_spans(df, id_col, text_col, length, **options)
    rows = _keyed(df, id_col, text_col).join(spans, ["k", "t"], "left")

    @F.pandas_udf("n_removed long, spans array<struct<lo:bigint,hi:bigint>>, kept binary, kept_sha256 string")
    def apply(body, spans):
        import pandas as pd

        out = []
        for b, found in zip(body, spans):
            ranges = merge([(s["lo"], s["hi"]) for s in found]) if found is not None else []
            at, kept = 0, []
            for lo, hi in ranges:
                kept.append(b[at:lo])
                at = hi
            rest = b"".join([*kept, b[at:]])
            out.append((len(b) - len(rest), [{"lo": lo, "hi": hi} for lo, hi in ranges], rest, hashlib.sha256(rest).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "spans", "kept", "kept_sha256"])

    return (rows.select("id", F.octet_length("body").cast("long").alias("n_bytes"), apply("body", "spans").alias("r"))
            .select(F.col("id").alias(id_col), "n_bytes", "r.*"))
