"""Fill-in-middle transformation: a wavelet matrix over character classes finds the cuts.

Every character of a text gets one of four classes (letter or digit, other
visible character, blank, line break), and with the class of the character
behind it one of 16 symbols. A wavelet matrix over the symbols of a run of
texts answers how often any symbol occurs before a place (``rank``). A unit
(word, line, character) ends where one of a few symbols stands, so the
units before a place are a sum of ranks (``Boundaries.count``), and the
place where the k-th unit ends is found by bisection on that sum, or by
``select`` where a single symbol ends the unit.

Words are ``[blanks]*[visible]+`` or the blanks that end a text; blanks are
space and tab..CR. A line is everything up to and with ``\\n``, or the rest. Four numbers
are drawn from the sha256 of ``seed:id``: two give the cuts, in units from 0
to n, the third whether the text is transformed, the fourth the form.

=====  =================================================
plain  the text
psm    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
spm    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
=====  =================================================

A null text counts as empty. Empty texts and texts with a sentinel stay plain,
which also keeps the transformation reversible: ``restore`` rebuilds the text
from output and form alone. A null id draws as an empty one, equal ids draw
alike (the draws depend on the id only, the cuts on the text as well), so
repeated rows come out equal. Texts are never cut short: a batch is worked on
in runs of at most ``RUN_CHARS`` characters, a longer text is a run of its own.
Extra columns are neither read nor returned, unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
TRANSFORMED, SPM = 50, 80               # per cent of the texts, and of the transformed ones
RUN_CHARS = 1 << 20

WORD, VISIBLE, BLANK, BREAK = range(4)
_CLASS = np.full(129, VISIBLE, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[10] = BREAK
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = WORD
_CLASS[128] = WORD                       # all characters beyond ASCII

#: Symbols (class, class behind) that end a unit.
ENDS = {
    "word": [4 * a + b for a in (WORD, VISIBLE) for b in (BLANK, BREAK)],
    "line": [4 * BREAK + b for b in range(4)],
    "char": list(range(16)),
}


class WaveletMatrix:
    """Rank, select and access over a sequence of small symbols.

    One bit vector per bit of the symbols, highest first; behind each level the
    zeros stand before the ones in their old order. All queries take arrays.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        order = np.asarray(symbols, np.uint8)
        for b in range(bits - 1, -1, -1):
            bit = (order >> b) & 1
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            ones = bit.astype(bool)
            self.levels.append((words, before, self.n - int(bit.sum(dtype=np.int64))))
            order = np.concatenate([order[~ones], order[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        w = at >> 6
        inside = words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[w] + np.bitwise_count(inside)

    def rank(self, symbol: int, at) -> np.ndarray:
        """Occurrences of the symbol in the first ``at`` places."""
        at = np.asarray(at, np.int64)
        start = np.zeros_like(at)
        for k in range(self.bits):
            first, ones = self._ones(k, start), self._ones(k, at)
            if symbol >> (self.bits - 1 - k) & 1:
                zeros = self.levels[k][2]
                start, at = zeros + first, zeros + ones
            else:
                start, at = start - first, at - ones
        return at - start

    def select(self, symbol: int, nth) -> np.ndarray:
        """Place of the ``nth`` occurrence (from 0), which must exist."""
        lo = np.zeros_like(np.asarray(nth, np.int64))
        hi = np.full_like(lo, self.n)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.rank(symbol, mid + 1) <= nth
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def access(self, at) -> np.ndarray:
        """Symbol at each place."""
        at = np.asarray(at, np.int64)
        out = np.zeros_like(at)
        for k, (words, _, zeros) in enumerate(self.levels):
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(k, at)
            at = np.where(bit, zeros + ones, at - ones)
            out = out * 2 + bit
        return out


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the concatenated texts, start of each text and the end). The
    last character of a text has a line break behind it, whatever follows."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    cls = _CLASS[np.minimum(codes, 128)]
    behind = np.full(len(cls), BREAK, np.uint8)
    behind[:-1] = cls[1:]
    last = edges[1:][np.diff(edges) > 0] - 1
    behind[last] = BREAK
    return cls * 4 + behind, edges


class Boundaries:
    """Unit counts and cuts in a run of texts, all texts at once."""

    def __init__(self, texts: list[str], unit: str = "word"):
        self.symbols, self.ends = ENDS[unit], None
        symbols, self.edges = classes(texts)
        self.matrix = WaveletMatrix(symbols, 4)
        self.first, self.end = self.edges[:-1], self.edges[1:]
        self.base = self._ranks(self.first)
        # characters behind the last end of a unit are a unit as well
        some = self.end > self.first
        final = np.zeros(len(self.first), np.int64)
        final[some] = self.matrix.access(self.end[some] - 1)
        self.open = some & ~np.isin(final, self.symbols)
        self.closed = self._ranks(self.end) - self.base
        self.n = self.closed + self.open

    def _ranks(self, at) -> np.ndarray:
        """Ends of units before each place: ranks of all symbols that end one."""
        if len(self.symbols) == 16:
            return np.asarray(at, np.int64)
        return sum(self.matrix.rank(s, at) for s in self.symbols)

    def count(self, at) -> np.ndarray:
        """Units that end in the first characters of each text."""
        at = np.asarray(at, np.int64)
        return self._ranks(self.first + at) - self.base + (self.open & (at == self.end - self.first))

    def cut(self, units) -> np.ndarray:
        """Characters of the first so many units (0 to n) of each text."""
        units = np.asarray(units, np.int64)
        lo, hi = self.first.copy(), self.end.copy()
        goal = self.base + units
        # smallest place with that many ends before it; the open unit ends with the text
        while (busy := lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self._ranks(mid) >= goal
            hi = np.where(busy & enough, mid, hi)
            lo = np.where(busy & ~enough, mid + 1, lo)
        return lo - self.first


def draws(ident, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    name = "" if ident is None else str(ident)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i: i + 8], 16) for i in (0, 8, 16, 24)]


def runs(texts: list[str]) -> Iterator[slice]:
    """Neighbouring texts of RUN_CHARS characters together, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > RUN_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def transform_texts(ids: list, texts: list[str], unit: str = "word", seed: int = SEED) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    out = []
    for part in runs(texts):
        group = texts[part]
        bounds = Boundaries(group, unit)
        h = np.array([draws(i, seed) for i in ids[part]], np.int64)
        places = h[:, :2] % (bounds.n + 1)[:, None]
        prefix = bounds.cut(places.min(axis=1))
        middle = bounds.cut(places.max(axis=1))
        for k, text in enumerate(group):
            n = int(bounds.n[k])
            if not text or h[k, 2] % 100 >= TRANSFORMED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                out.append((n, "plain", None, None, text))
                continue
            a, b = int(prefix[k]), int(middle[k])
            if h[k, 3] % 100 < SPM:
                form, made = "spm", [SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]]
            else:
                form, made = "psm", [PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]]
            out.append((n, form, a, b - a, "".join(made)))
    return out


def fill_in_middle(df: DataFrame, unit: str = "word", seed: int = SEED, id_col="doc_id", text_col="text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns of ``keep``, n (units of the text), form, prefix_chars,
    middle_chars (null if plain) and output of every row."""
    if unit not in ENDS:
        raise ValueError(f"unit must be one of {sorted(ENDS)}")
    ship(df.sparkSession)
    made = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add(
        "output", "string")

    @F.pandas_udf(made)
    def transform(ident, text):
        import pandas as pd

        ids = ident.astype(object).where(ident.notna(), None).tolist()
        rows = transform_texts(ids, [t or "" for t in text.where(text.notna(), None)], unit, seed)
        table = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return table.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text: a null among integers would turn them into floats
    found = transform(F.col(id_col).cast("string"), F.col(text_col))
    names = [id_col, *keep]
    return df.select(*names, found.alias("made")).select(*names, "made.*")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. The sentinels occur in no
    transformed text, and no text beside one can complete another, so each
    stands exactly once."""
    parts = F.split(output, "<[PSM]>")
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return (F.when(form == "psm", F.concat(*[F.get(parts, F.lit(i)) for i in at["psm"]]))
            .when(form == "spm", F.concat(*[F.get(parts, F.lit(i)) for i in at["spm"]])).otherwise(output))
