"""Document fingerprints by a randomised edit embedding.

A walk reads a text from left to right: at every step it emits the character
under it and then moves on or stays, as a coin says that depends on the step
and the character only. All texts share the coins. Walks over two texts that
differ by a few edits fall into step again soon after each edit, so the edit
distance becomes a Hamming distance between the emitted sequences.

A fingerprint samples ``SAMPLES`` steps of each of ``WALKS`` walks and keeps
four hashed bits (one hex digit) of the character emitted there. The sampled
step is uniform over the length of the walk and stays the same for as many
lengths as possible (a step of a text twice as long is the old one with
probability 1/2), so texts of different length compare as well. ``likeness``
is the share of equal digits: 1 for equal texts, some 0.1 to 0.15 for unrelated ones.

``near_documents`` bands the digits, ``ROWS`` neighbouring samples of one walk a band, and
verifies the pairs that share a band by their edit distance: at most
``max_edits`` of the longer text's characters. Two texts whose digits agree at a
rate a meet with probability 1 - (1 - a**8)**32: 0.997 at 0.8, 1 - 4e-8 at 0.9. An edit distance far
below the bound may still disturb a walk for long; recall on planted edits is measured in the tests.

Characters are code points. A null text counts as empty; an empty text emits
one end mark, so all empty texts are equal and unlike any other. Texts are
read whole, at a memory of a few bytes a character. Equal texts have equal
fingerprints. Rows with a null id are fingerprinted but linked with nothing.
Rows that share an id are one document in ``near_documents``. Columns other
than id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _links
from ._util import mix64, save, ship, shuffle_partitions

WALKS, SAMPLES = 4, 64
ROWS = 8                                # digits of a band
MAX_EDITS = 0.1
PERIOD = 1 << 13                        # steps after which the coins repeat
CLASSES = 128                           # the coins know a character by its lowest bits
GROUP_TEXTS = 256                       # texts that walk side by side
PIECE_CHARS, PIECE_TEXTS = 1 << 24, 8192  # texts that a stream holds at once, about
NARROW = 24                             # fewer texts than these walk one by one
TILE = 64                               # steps turned round at once, from by step to by text
BLOCK = 4096                            # characters walked before samples are taken
_END = 0x110000                         # emitted by an empty text
_SALT = mix64(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@cache
def _coins() -> np.ndarray:
    """Steps that a walk spends on a character, by walk, class and step modulo
    PERIOD: up to and with the first step whose coin says to move on."""
    rng, out = np.random.default_rng(1117), []
    for _ in range(WALKS):
        move = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
        move[:, 0] = True               # a move within every period
        at = np.where(np.tile(move, 2), np.arange(2 * PERIOD, dtype=np.int32), np.int32(4 * PERIOD))
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        out.append((following - np.arange(PERIOD, dtype=np.int32) + 1).astype(np.uint8).ravel())
    return np.concatenate(out)


@cache
def _coin_bytes() -> list[bytes]:
    """The same by walk, for a walk in plain Python."""
    return [part.tobytes() for part in _coins().reshape(WALKS, -1)]


@cache
def _records() -> np.ndarray:
    """Sampled steps by walk, sample and turn, ascending: the sample of a walk
    of length n is the last one below n. Behind step r the next record comes
    at floor((r + 1) / u), u uniform, so it is below n with the probability that makes the
    sample uniform over 0..n-1."""
    rng = np.random.default_rng(1123)
    columns, last = [np.zeros((WALKS, SAMPLES), np.int64)], np.zeros((WALKS, SAMPLES))
    while last.min() < 2.0**40:
        last = np.minimum(np.floor((last + 1) / (1 - rng.random(last.shape))), 2.0**41)
        columns.append(last.astype(np.int64))
    return np.stack(columns, axis=2)


def _samples(length: np.ndarray) -> np.ndarray:
    """Sampled step of every walk and sample, for a walk length per walk."""
    records = _records()
    turn = (records < length[:, None, None]).sum(axis=2) - 1
    return np.take_along_axis(records, turn[:, :, None], axis=2)[:, :, 0]


def _digits(symbols: np.ndarray) -> bytes:
    """Hex digits of the sampled characters."""
    return _HEX[(mix64(symbols.astype(np.uint64) + _SALT) >> np.uint64(60)).astype(np.intp)].tobytes()


def _walk(group: list[str]) -> list[bytes]:
    """Fingerprints of non-empty texts, longest first. All texts take their
    i-th character at once; samples are taken block by block."""
    coins, many = _coins(), len(group)
    lengths = np.array([len(t) for t in group])
    symbols = np.zeros((many, WALKS * SAMPLES), np.int64)
    time = np.zeros((WALKS, many), np.int64)
    offset = (np.arange(WALKS, dtype=np.int64) * CLASSES * PERIOD)[:, None]
    shift = np.arange(WALKS, dtype=np.int64)[:, None] << 48
    for start in range(0, int(lengths[0]), BLOCK):
        live = int((lengths > start).sum())
        steps = min(BLOCK, int(lengths[0]) - start)
        codes = [np.frombuffer(t[start: start + steps].encode("utf-32-le", "surrogatepass"), np.uint32) for t in group[:live]]
        classes = np.zeros((live, steps), np.int32)
        for k, part in enumerate(codes):
            classes[k, : len(part)] = (part & (CLASSES - 1)) * np.uint32(PERIOD)
        active = (lengths[:live, None] > start + np.arange(steps)[None, :]).sum(axis=0)
        together = int((active >= NARROW).sum())
        ends = np.empty((live, WALKS, steps), np.int64)
        tile = np.empty((TILE, WALKS, live), np.int64)
        began = time[:, :live].copy()
        now = began.copy()
        columns = np.ascontiguousarray(classes[:, :together].T)
        for first in range(0, together, TILE):
            last = min(first + TILE, together)
            for i in range(first, last):
                if active[i] < now.shape[1]:        # ended texts stand still, at the right
                    now = now[:, : active[i]].copy()
                at = now & (PERIOD - 1)
                at += columns[i, : active[i]]
                at += offset
                now += coins[at]
                tile[i - first, :, : active[i]] = now
            ends[:, :, first:last] = tile[: last - first].transpose(2, 1, 0)
        for k in range(int(active[together]) if together < steps else 0):
            rest = classes[k, together: len(codes[k])].tolist()
            for w, moves in enumerate(_coin_bytes()):
                t = int(now[w, k])
                ends[k, w, together: together + len(rest)] = [t := t + moves[c + (t & (PERIOD - 1))] for c in rest]
        for k in range(live):
            n = len(codes[k])
            own = ends[k, :, :n]
            time[:, k] = own[:, -1]
            wanted = _samples(time[:, k])
            due = wanted >= began[:, k, None]
            flat = np.ascontiguousarray(own + shift).ravel()
            place = np.searchsorted(flat, (wanted + shift).ravel(), side="right").reshape(WALKS, SAMPLES)
            place -= np.arange(WALKS)[:, None] * n
            due = due.ravel()
            symbols[k, due] = codes[k][place.ravel()[due]]
    return [_digits(row) for row in symbols]


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprint of each text: WALKS * SAMPLES hex digits."""
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    blank = _digits(np.full(WALKS * SAMPLES, _END)).decode()
    out = [blank] * len(texts)
    for start in range(0, len(order), GROUP_TEXTS):
        group = order[start: start + GROUP_TEXTS]
        for i, made in zip(group, _walk([texts[i] for i in group])):
            out[i] = made.decode()
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Share of equal digits of each pair of fingerprints."""
    x, y = (np.frombuffer("".join(v).encode(), np.uint8).reshape(len(v), -1) for v in (a, b))
    return (x == y).mean(axis=1)


def fingerprints(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_chars, fingerprint of every row."""
    ship(df.sparkSession)

    @F.pandas_udf("n_chars long, fingerprint string")
    def scan(text):
        import pandas as pd

        texts = [t or "" for t in text.where(text.notna(), None)]
        return pd.DataFrame({"n_chars": [len(t) for t in texts], "fingerprint": fingerprint_texts(texts)})

    return df.select(id_col, scan(F.col(text_col)).alias("made")).select(id_col, "made.*")


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two texts, or ``limit + 1`` if it is larger. The columns
    of the table are bit vectors in whole integers."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in sorted((a, b), key=len))
    short = len(x)
    same = np.flatnonzero(x != y[:short])
    front = int(same[0]) if len(same) else short
    x, y = x[front:], y[front:]
    differ = np.flatnonzero(x != y[len(y) - len(x):])
    back = len(x) - 1 - int(differ[-1]) if len(differ) else len(x)
    x, y = x[: len(x) - back], y[: len(y) - back]
    if not len(x):
        return min(len(y), limit + 1)
    full = (1 << len(x)) - 1
    top = 1 << (len(x) - 1)
    places = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    up, down, score, left = full, 0, len(x), len(y)
    for c in y.tolist():
        match = places.get(c, 0) | down
        diagonal = (((match & up) + up) ^ up) | match
        more = (down | ~(diagonal | up)) & full
        less = diagonal & up
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        left -= 1
        if score - left > limit:
            return limit + 1
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up = (less | ~(diagonal | more)) & full
        down = more & diagonal
    return score


def _verifier(texts: DataFrame, max_edits: float):
    """Pairs -> those whose edit distance is small enough."""

    @F.pandas_udf("boolean")
    def near(a, b):
        import pandas as pd

        limits = (int(max_edits * max(len(s), len(t))) for s, t in zip(a, b))
        return pd.Series([edit_distance(s, t, k) <= k for s, t, k in zip(a, b, limits)], dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(left, "a").join(right, "b").where(near("ta", "tb")).select("a", "b")

    return verify


def near_documents(df: DataFrame, max_edits: float = MAX_EDITS, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_chars, fingerprint, group_id (smallest id reachable over links), kept for every row.

    Equal texts (by sha256) are one class; its smallest id alone takes part in
    banding. Empty texts are linked with nothing.
    """
    ship(df.sparkSession)
    named = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = save(fingerprints(named.withColumn("key", F.struct("id", F.sha2("text", 256).alias("sha"))), "key", "text")
                  .select("key.*", "n_chars", "fingerprint"), "fingerprints")
    real = prints.where("id is not null and n_chars > 0")
    classes = save(real.groupBy("sha").agg(F.min("id").alias("rep"), F.first("n_chars").alias("size"),
                                           F.first("fingerprint").alias("fingerprint")), "classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(WALKS * SAMPLES // ROWS - 1)),
                        lambda b: F.xxhash64(b, F.col("fingerprint").substr(b * ROWS + 1, F.lit(ROWS))))
    held = classes.select(F.col("rep").alias("id"), F.col("size"), F.explode(bands).alias("bucket")).distinct()
    shared = held.groupBy(F.col("bucket").alias("y")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    members = save(held.join(shared.select("y"), F.col("bucket").eqNullSafe(F.col("y"))).select("bucket", "id", "size"), "members")
    wanted = members.select(F.col("id").alias("x")).distinct()
    texts = save(named.where("text <> ''").distinct().join(wanted, F.col("id").eqNullSafe(F.col("x"))).drop("x"), "texts")
    linked = _links.link(members, _verifier(texts, max_edits), 1 - max_edits)
    joined = real.select("id", "sha").join(classes.select("sha", "rep"), "sha").where("id <> rep").select(
        F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    found = _links.components(joined.unionAll(linked.where("id <> component").select(
        F.col("id").alias("a"), F.col("component").alias("b"))))
    group = F.coalesce("component", "id")
    return prints.join(found, "id", "left").select(
        F.col("id").alias(id_col), "n_chars", "fingerprint", group.alias("group_id"),
        F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def half_replaced(text: str, other: str) -> str:
    """The last half of a text replaced by as many characters from the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_MADE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pieces(texts) -> Iterator[slice]:
    """Neighbouring texts of about PIECE_CHARS characters, at most PIECE_TEXTS."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_CHARS or i + 1 - start >= PIECE_TEXTS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _compare(texts: list[str], others: list[str], prints: list[str], other_prints: list[str], edit: Callable[[str, str], str]):
    import pandas as pd

    edited = [edit(t, o) for t, o in zip(texts, others)]
    edited_prints = fingerprint_texts(edited)
    return pd.DataFrame({
        "n_chars": np.array([len(t) for t in texts], np.int64),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": prints, "edited_fingerprint": edited_prints,
        "near_edited": likeness(prints, edited_prints), "near_next": likeness(prints, other_prints)})


def compare_with_next(df: DataFrame, edit: Callable[[str, str], str] = half_replaced, id_col="doc_id",
                      text_col="text") -> DataFrame:
    """Every text beside the next one in descending order of id (behind the last
    comes the first; a single row is its own next): id, n_chars, sha256 of
    ``edit(text, next text)``, both fingerprints, likeness of the text's fingerprint to the
    edited text's and to the next text's.

    Null ids come last, rows of one id by a hash of their text; rows equal in both are interchangeable. One
    range exchange orders the rows, each range partition is read once as a stream. Only the first
    and the last row of a partition, whose neighbour is elsewhere, are written with their texts and matched by partition.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("at")]
    ranged = (rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
              .repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
              .select(F.col("id").cast("string"), "text"))             # as text: pandas would make nulls among integers floats
    made = T._parse_datatype_string(_MADE)
    schema = T.StructType([T.StructField("id", T.StringType()), *made.fields, T.StructField("part", T.IntegerType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def pass_by(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [f.name for f in schema.fields]

        def edge(ident, text, made_print, role):
            row = (ident, len(text), None, made_print, None, 0.0, 0.0, part, role, text)
            return pd.DataFrame([row], columns=names).astype({"part": np.int32})

        held = None                                       # (id, text, fingerprint)
        for pdf in batches:
            for piece in _pieces(pdf["text"]):
                ids, texts = pdf["id"].iloc[piece].tolist(), pdf["text"].iloc[piece].tolist()
                prints = fingerprint_texts(texts)
                if held is None:
                    yield edge(ids[0], texts[0], prints[0], "head")
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
                if len(texts) > 1:
                    done = _compare(texts[:-1], texts[1:], prints[:-1], prints[1:], edit)
                    yield done.assign(id=ids[:-1], part=np.int32(part), role="row", text=None)[names]
                held = (ids[-1], texts[-1], prints[-1])
        if held is not None:
            yield edge(*held, "tail")

    hexed = ("fingerprint", "edited_fingerprint")
    table = save(ranged.mapInPandas(pass_by, schema).withColumns({c: F.unhex(c) for c in hexed}), "neighbours")
    table = table.withColumns({c: F.lower(F.hex(c)) for c in hexed})
    parts = sorted(r["part"] for r in table.where("role = 'head'").select("part").collect())   # one row per partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = table.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                                F.col("fingerprint").alias("next_print"))
    tails = (table.where("role = 'tail'").select("id", "text", "fingerprint", "part").join(F.broadcast(follows), "part")
             .join(heads, "next_part"))

    @F.pandas_udf(_MADE)
    def compare(text, other, made_print, other_print):
        return _compare(text.tolist(), other.tolist(), made_print.tolist(), other_print.tolist(), edit)

    columns = [F.col("id").cast(kind).alias(id_col), *made.names]
    return table.where("role = 'row'").select(*columns).unionAll(
        tails.select("id", compare("text", "next_text", "fingerprint", "next_print").alias("made"))
        .select("id", "made.*").select(*columns))
