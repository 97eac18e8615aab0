"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles (A-Z lower-cased, words
are runs of bytes other than space and tab..CR; with fewer words than a
shingle needs, the whole sequence is one). One pass over the texts gives a
128-bit fingerprint of the set and a signature: ``HASHES`` permutations, of
each both the minimum and the maximum, so 2 * HASHES unbiased values from
HASHES evaluations. ``BANDS`` bands of ``ROWS`` values make the candidates:
with the defaults a pair at similarity 0.8 shares no band with a probability
of 8e-6. One bit of each value is kept as a sketch; pairs of a band whose
sketches differ in more than FAR bits (1e-8 at similarity 0.8) are not compared.

Documents of equal word sequence (by the first 128 bits of its sha256) form a class; only one per class, its smallest
id, takes part in banding. All other candidates are compared on their full sets of word
tuples. Links are completed by ``_links.link`` and turned into components.

Null and empty texts and texts without a word have an empty set and are linked
with nothing. Rows that share an id count as one document: they end in one
component, whose member they are as a whole. Rows with a null id are linked
with nothing, have a null component and are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _links
from ._util import PrefixHash, mix64, save, scratch

HASHES, BANDS, ROWS = 175, 50, 7
SKETCH = -(-2 * HASHES // 64)
#: Differing sketch bits beyond which a pair is no candidate: at similarity 0.8 a
#: tenth of the 350 bits differs on average (standard deviation 5.6); 70 is beyond six of those.
FAR = 70
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = np.random.default_rng(41).integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = np.random.default_rng(42).integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_set(text: str | None, width: int) -> set:
    """The set of word tuples, empty for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


_PRIME, _RADIX = (1 << 31) - 1, 1_103_515_245
_LETTER = np.random.default_rng(43).integers(1, _PRIME, 256, dtype=np.uint64)
_radix_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo the prime."""
    while len(_radix_powers[0]) < n:
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, _PRIME))):
            known = _radix_powers[k]
            _radix_powers[k] = np.concatenate([known, known * np.uint64(pow(base, len(known), _PRIME)) % np.uint64(_PRIME)])
    return _radix_powers[0][:n], _radix_powers[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a byte string: a polynomial modulo 2**64, which
    words of a self-similar pattern can collide in, mixed with one modulo a prime and the word's length."""
    prime, (power, inverse) = np.uint64(_PRIME), _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)] % prime, out=sums[1:])
    second = (sums[ends] - sums[starts]) % prime * inverse[starts] % prime
    length = (ends - starts).astype(np.uint64)
    return mix64(PrefixHash(data).of(starts, ends) ^ mix64(second + (length << np.uint64(32))))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER_TABLE = np.frombuffer(_LOWER, np.uint8)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    data = _LOWER_TABLE[data]
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashes = word_hashes(data, starts, ends)
    many = max(1, len(hashes) - width + 1)
    out = np.full(many, np.uint64(min(width, len(hashes))))
    for i in range(min(width, len(hashes))):
        out = mix64(out * np.uint64(0xA0761D6478BD642F) + hashes[i: i + many])
    return np.unique(out)


def sequence_key(text: str) -> tuple[int, int]:
    """128 bits of the sha256 of a text's words, equal for equal word sequences only."""
    words = b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    digest = hashlib.sha256(words).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketch) of a non-empty set of shingle hashes: BANDS and
    SKETCH int64. The sketch holds one hashed bit of every signature value."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    high = np.zeros(HASHES, np.uint32)
    for s in range(0, len(x), 512):                  # stays in cache, and bounded for long texts
        part = _MULTIPLIERS[:, None] * x[None, s: s + 512] + _OFFSETS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
        np.maximum(high, part.max(axis=1), out=high)
    values = np.concatenate([low, high]).astype(np.uint64).reshape(ROWS, BANDS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in values:
        key = mix64(key * np.uint64(0xE7037ED1A0B428DB) + row)
    bits = mix64(values.ravel() + (np.arange(values.size, dtype=np.uint64) << np.uint64(32))) >> np.uint64(63)
    packed = np.packbits(bits.astype(np.uint8))
    return key.view(np.int64), np.frombuffer(packed.tobytes().ljust(8 * SKETCH, b"\0"), np.int64)


def fingerprints(df: DataFrame, width: int, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_shingles, f1, f2 (word sequence), bands (packed int64 keys)."""

    @F.pandas_udf("n long, f1 long, f2 long, bands binary, sketch array<long>")
    def scan(text):
        import pandas as pd

        rows = []
        for t in text.where(text.notna(), None):
            h = shingle_hashes(t, width)
            if not len(h):
                rows.append((0, 0, 0, None, None))
                continue
            keys, sketch = signature(h)
            rows.append((len(h), *sequence_key(t), keys.tobytes(), sketch))
        return pd.DataFrame(rows, columns=["n", "f1", "f2", "bands", "sketch"])

    return df.select(F.col(id_col).alias("id"), scan(F.col(text_col)).alias("s")).select("id", "s.*")


def unpack(bands: DataFrame) -> DataFrame:
    """(bucket, id, size) rows of packed band keys."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                keys = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["bands"]])
                yield pd.DataFrame({"bucket": keys, "id": np.repeat(pdf["id"].to_numpy(), BANDS),
                                    "size": np.repeat(pdf["size"].to_numpy(), BANDS)})

    return bands.mapInPandas(rows, "bucket long, id long, size long")


def _verifier(texts: DataFrame, width: int, percent: int):
    """Pairs -> those whose full sets reach the similarity."""

    @F.pandas_udf("boolean")
    def similar(a, b):
        import pandas as pd

        out, seen = [], {}
        for s, t in zip(a, b):
            sets = []
            for x in (s, t):
                if x not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[x] = shingle_set(x, width)
                sets.append(seen[x])
            both = len(sets[0] & sets[1])
            out.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
        return pd.Series(out, dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(left, "a").join(right, "b").where(similar("ta", "tb")).select("a", "b")

    return verify


def _sets_of(texts: DataFrame, width: int):
    """Ids -> their shingle hashes; an id with several texts has those of all."""

    @F.pandas_udf("array<long>")
    def hashes(text):
        import pandas as pd

        return pd.Series([shingle_hashes(t, width).view(np.int64) for t in text], dtype=object)

    def items(ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col("id").alias("x")).distinct()
        found = texts.join(wanted, F.col("id").eqNullSafe(F.col("x"))).select("id", hashes("text").alias("items"))
        return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    return items


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``df``."""
    spark = df.sparkSession
    prints = save(fingerprints(df, width, id_col, text_col), "fingerprints")
    sets = prints.where("id is not null and n > 0")
    classes = save(sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    # a class is named by its smallest id; an id with several texts is in several classes
    classed = sets.select("id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("id", "rep")
    reps = sets.join(classes.select("f1", "f2", "n", F.col("rep").alias("id")), ["f1", "f2", "n", "id"], "left_semi")
    reps = reps.dropDuplicates(["id", "f1", "f2"])
    bands = save(unpack(reps.select("id", F.col("n").alias("size"), "bands")), "bands")
    shared = save(bands.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                  .where("lo <> hi").select("bucket"), "buckets")
    bits = reps.select(F.col("id").alias("x"), "sketch")
    members = bands.join(shared, "bucket").distinct().join(bits, F.col("id").eqNullSafe(F.col("x"))).drop("x")
    members = save(members, "members")
    wanted = members.select(F.col("id").alias("x")).distinct()
    # the text of a candidate: one row per class (an id with several texts is compared by each of them)
    texts = save(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                 .join(wanted, F.col("id").eqNullSafe(F.col("x"))).drop("x"), "texts")
    linked = _links.link(members, _verifier(texts, width, percent), percent / 100, FAR, _sets_of(texts, width))
    edges = classed.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct().unionAll(
        linked.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    final = _links.components(edges)
    out = prints.select("id", "n").join(final, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``df`` whose document is the one kept of its component."""
    with scratch(df.sparkSession) as keep:
        gone = keep(save(near_duplicates(df, width, percent, id_col, text_col).where("not kept")
                         .select(F.col(id_col).alias("_gone")).distinct(), "gone"))
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
