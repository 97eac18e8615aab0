"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is segmented into pieces of a given vocabulary so that the sum of the
pieces' scores is greatest (Viterbi). Blanks become the mark U+2581, one mark is
put in front, and characters outside the vocabulary fall back to the pieces of
their UTF-8 bytes, so decoding gives back exactly the text; a literal U+2581 is
coded by its bytes. Scores are integers (scaled log probabilities), which makes
max-plus products associative without rounding. Vocabularies that carry ranks
instead of probabilities (all scores whole numbers) get ``ln 1 / (rank + 2.7)``.

Texts of more than ``CHUNK`` characters are cut into chunks of that length. The
state at a boundary is the number of characters by which the piece across it
reaches into the next chunk. Each chunk yields the matrix of best scores from
its entry to its exit states; matrices are multiplied in blocks of ``BLOCK``
chunks and the block products along the document, which fixes the state at each
boundary; every chunk is then traced back on its own. Shorter texts are one
chunk. Where no piece crosses a place (before a mark that follows another
character, around a line end that no piece holds) the path is forced through it,
so chunks are mostly coded by words whose best segmentation is remembered.

Null and empty texts have no pieces; decoding those gives the empty text. Rows
equal in id and text share their result.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import one_model, save

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 1 << 16, 64
MARK = "▁"
_LITERAL = "\ud800"              # stands for a literal mark inside: no valid text holds it
_NEVER = -(1 << 60)
_ROWS = 256                      # texts coded at once
_REMEMBERED = 250_000            # words remembered by a worker in each of two generations


def load_vocabulary(path: str = VOCABULARY) -> dict:
    """pieces: text -> (id, score); bytes: ids and scores of the byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, raw = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(piece[3:5], 16)] = (i, model.get_score(i))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append((piece, i, model.get_score(i)))
    if len(raw) < 256:
        raise ValueError("the vocabulary has no byte pieces to fall back to")
    if all(float(s).is_integer() for _, _, s in normal):
        ranks = {i: r for r, (_, i, _) in enumerate(sorted(normal, key=lambda x: -x[2]))}
        total = float(np.sum(1 / (np.arange(len(normal)) + 2.7)))
        normal = [(p, i, -np.log((ranks[i] + 2.7) * total)) for p, i, _ in normal]
    least = min(s for _, _, s in normal)
    scale = 1 << 20
    return {"pieces": {p: (i, int(round(s * scale))) for p, i, s in normal},
            "bytes": [(raw[b][0], int(round((least - 1) * scale))) for b in range(256)]}


class Coder:
    def __init__(self, vocabulary: dict):
        self.pieces = vocabulary["pieces"]
        self.raw = vocabulary["bytes"]
        self.longest = max(map(len, self.pieces))
        # every beginning of a piece: (id, score) if it is a piece itself, else None
        self.tree = {p[:n]: None for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.text_of: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        for b, (i, _) in enumerate(self.raw):
            self.text_of[i] = bytes([b])
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        line = any("\n" in p for p in self.pieces if len(p) > 1)
        stop = MARK if line else MARK + "\n"
        # words: forced places lie between them; the whole text if pieces hold inner marks
        self.words = re.compile("(?s:.+)" if inner else f"{MARK}+[^{stop}]*|[^{stop}]+" + ("" if line else "|\n"))
        self.known: dict[str, tuple[int, bytes]] = {}
        self.before: dict[str, tuple[int, bytes]] = {}

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)

    def _fallback(self, c: str):
        data = (MARK if c == _LITERAL else c).encode("utf-8", "surrogatepass")
        return [self.raw[b][0] for b in data], sum(self.raw[b][1] for b in data)

    def _edges(self, s: str, i: int):
        """(end, score, ids) of the pieces of s that start at i."""
        tree = self.tree
        for j in range(i + 1, min(i + self.longest, len(s)) + 1):
            p = s[i:j]
            if p not in tree:
                break
            hit = tree[p]
            if hit:
                yield j, hit[1], [hit[0]]
        if not self.pieces.get(s[i]):
            ids, score = self._fallback(s[i])
            yield i + 1, score, ids

    def path(self, s: str, start: int, end: int) -> tuple[int, list[int]]:
        """Best segmentation of s[start:end] (ties: the longer last piece)."""
        part = s[start:end]
        size, longest, tree = len(part), self.longest, self.tree
        best = [_NEVER] * (size + 1)
        back, coded = [0] * (size + 1), [None] * (size + 1)
        best[0] = 0
        for i in range(size):                         # every place can be reached: each character has an edge
            here, single = best[i], False
            for j in range(i + 1, min(i + longest, size) + 1):
                p = part[i:j]
                if p not in tree:
                    break
                hit = tree[p]
                if hit:
                    single = single or j == i + 1
                    score = here + hit[1]
                    if score > best[j]:
                        best[j], back[j], coded[j] = score, i, hit[0]
            if not single:
                ids, score = self._fallback(part[i])
                if here + score > best[i + 1]:
                    best[i + 1], back[i + 1], coded[i + 1] = here + score, i, ids
        out, j = [], size
        while j:
            ids = coded[j]
            out.extend(ids[::-1] if isinstance(ids, list) else (ids,))
            j = back[j]
        return best[-1], out[::-1]

    def word(self, w: str) -> tuple[int, bytes]:
        """(score, packed ids) of a word, remembered."""
        hit = self.known.get(w)
        if hit is None:
            hit = self.before.get(w)
            if hit is None:
                score, ids = self.path(w, 0, len(w))
                hit = score, array("i", ids).tobytes()
            if len(w) <= 64:
                if len(self.known) >= _REMEMBERED:    # words not met for that many new ones are forgotten
                    self.known, self.before = {}, self.known
                self.known[w] = hit
        return hit

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as one chunk."""
        if not text:
            return np.zeros(0, np.int32)
        word = self.word
        return np.frombuffer(b"".join([word(w)[1] for w in self.words.findall(self.marked(text))]), np.int32)

    def decode(self, ids) -> str:
        text_of = self.text_of
        return b"".join([text_of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")

    # --- chunks of a long text: s = the chunk and up to longest - 1 characters behind it

    def _places(self, s: str, size: int) -> tuple[int, int, list[str]]:
        """(first, last, words between): forced places of the chunk that all
        entry states have passed; first = last = size if there is none."""
        places = [0]
        for w in self.words.findall(s[:size + 1] if len(s) > size else s[:size]):
            places.append(places[-1] + len(w))
        forced = [p for p in places[1:-1] if p >= self.longest - 1 and p <= size]
        if not forced:
            return size, size, []
        return forced[0], forced[-1], self.words.findall(s[forced[0]:forced[-1]])

    def matrix(self, s: str, size: int) -> np.ndarray:
        """Best score from each entry to each exit state (square, longest wide)."""
        n = self.longest
        first, last, words = self._places(s, size)
        out = np.full((n, n), _NEVER, np.int64)
        if first == size:                             # no common place: all entries side by side
            self._sweep(s, size, np.where(np.arange(n)[:, None] == np.arange(n)[None, :], 0, _NEVER), out)
            return out
        head = np.full((n, n), _NEVER, np.int64)
        self._sweep(s[:first], first, np.where(np.arange(n)[:, None] == np.arange(n)[None, :], 0, _NEVER), head)
        middle = sum(self.word(w)[0] for w in words)
        tail = np.full((1, n), _NEVER, np.int64)
        entry = np.full((1, n), _NEVER, np.int64)
        entry[0, 0] = 0
        self._sweep(s[last:], size - last, entry, tail)
        alive = (head[:, :1] > _NEVER) & (tail > _NEVER)
        return np.where(alive, head[:, :1] + middle + tail, _NEVER)

    def _sweep(self, s: str, size: int, entry: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over s[:size] for all rows of ``entry`` (score of starting at
        each of the first places), with pieces reaching past the end."""
        rows, n = entry.shape
        best = np.full((size + n + 1, rows), _NEVER, np.int64)
        best[:n] = entry.T
        for i in range(size):
            if best[i].max() > _NEVER:
                for j, score, _ in self._edges(s, i):
                    np.maximum(best[j], np.where(best[i] > _NEVER, best[i] + score, _NEVER), out=best[j])
        out[:] = best[size: size + n].T

    def trace(self, s: str, size: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the chunk's best path between two states."""
        first, last, words = self._places(s, size)
        end = size + leave
        if first == size:
            return np.array(self._through(s, entry, size, end), np.int32)
        parts = [np.array(self._through(s[:first], entry, first, first), np.int32)]
        parts += [np.frombuffer(self.word(w)[1], np.int32) for w in words]
        parts.append(np.array(self._through(s[last:end], 0, size - last, end - last), np.int32))
        return np.concatenate(parts)

    def _through(self, s: str, start: int, size: int, end: int) -> list[int]:
        """Best path from start to end in which no piece starts at or after
        ``size`` (those belong to the next chunk)."""
        best = {start: (0, None, None)}
        for i in range(start, size):
            if i in best:
                for j, score, ids in self._edges(s, i):
                    if j <= end and (j not in best or best[i][0] + score > best[j][0]):
                        best[j] = (best[i][0] + score, i, ids)
        out, j = [], end
        while j != start:
            _, i, ids = best[j]
            out.append(ids)
            j = i
        return [x for ids in reversed(out) for x in ids]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product; associative on integers."""
    both = a[:, :, None] + b[None, :, :]
    return np.where((a[:, :, None] > _NEVER) & (b[None, :, :] > _NEVER), both, _NEVER).max(axis=1)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """Best states at all boundaries between ``entry`` and ``leave``."""
    n = len(matrices[0])
    row = np.full((1, n), _NEVER, np.int64)
    row[0, entry] = 0
    rows = [row]
    for m in matrices:
        rows.append(max_plus(rows[-1], m))
    out = [leave]
    for row, m in zip(rows[-2::-1], matrices[::-1]):
        column = m[:, out[-1]]
        score = np.where((row[0] > _NEVER) & (column > _NEVER), row[0] + column, _NEVER)
        out.append(int(score.argmax()))
    return out[::-1]


def _coder(sent, key: int) -> Coder:
    from ledgerline.llm import piece_coding as module

    return module.one_model("piece_coding", key, lambda: module.Coder(sent.value))


def _send(spark, vocabulary):
    vocabulary = load_vocabulary() if vocabulary is None else vocabulary
    key = hash((tuple(sorted(vocabulary["pieces"].items())), tuple(vocabulary["bytes"])))
    return spark.sparkContext.broadcast(vocabulary), key, max(map(len, vocabulary["pieces"]))


def encode(df: DataFrame, vocabulary: dict | None = None, id_col="doc_id", text_col="text", chunk: int = CHUNK,
           block: int = BLOCK, keep: tuple = (), verify: bool = False) -> DataFrame:
    """id, the columns in ``keep`` and ids (array of int) for every row; with
    ``verify`` also round_trip: decoding gives back the text."""
    spark = df.sparkSession
    sent, key, longest = _send(spark, vocabulary)
    if chunk < 2 * longest:
        raise ValueError("chunks must be longer than two pieces")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def whole(batches):
        import pyarrow as pa

        coder = _coder(sent, key)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):        # few rows at a time: ids outweigh their text
                part = batch.slice(at, _ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = [coder.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out = [part.column(k) for k in range(part.num_columns - 1)]
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                if verify:
                    out.append(pa.array([(coder.decode(x.tolist()) if len(x) else "") == t for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(out, names)

    head = df.select(F.col(id_col), *keep)
    schema = T.StructType([*head.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("round_trip", T.BooleanType())] * verify)
    names = schema.names
    short = df.where(F.length(text) < chunk).select(F.col(id_col), *keep, text.alias("_text")).mapInArrow(whole, schema)
    named = df.where(F.length(text) >= chunk).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"),
        F.xxhash64(F.col(id_col).isNull(), text).alias("t"), text.alias("text"),
        F.struct(F.lit(0).alias("_none"), *keep).alias("keep"))
    named = save(named, "long-texts")
    if named.isEmpty():
        return short

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            for k, t, x in zip(pdf["k"], pdf["t"], pdf["text"]):
                s = Coder.marked(x)
                many = -(-len(s) // chunk)
                for c in range(many):
                    piece = s[c * chunk: (c + 1) * chunk + longest - 1]
                    yield pd.DataFrame({"k": [k], "t": [t], "c": [c], "many": [many],
                                        "piece": [piece.encode("utf-8", "surrogatepass")]})

    chunks = (named.select("k", "t", "text").dropDuplicates(["k", "t"]).mapInPandas(cut, "k long, t long, c int, many int, piece binary")
              .repartition(F.col("k"), F.col("t"), F.col("c")))
    chunks = save(chunks, "chunks")

    @F.pandas_udf("binary")
    def transfer(piece):
        import pandas as pd

        coder = _coder(sent, key)
        texts = [p.decode("utf-8", "surrogatepass") for p in piece]
        return pd.Series([coder.matrix(s, min(chunk, len(s))).tobytes() for s in texts])

    numbered = chunks.select("k", "t", "c", "many", F.floor(F.col("c") / block).cast("int").alias("b"), transfer("piece").alias("m"))
    numbered = save(numbered, "transfers")

    def unpack(column):
        return [np.frombuffer(m, np.int64).reshape(longest, longest) for m in column]

    def product(pdf):
        import pandas as pd

        pdf = pdf.sort_values("c")
        m = functools.reduce(max_plus, unpack(pdf["m"]))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "t": [pdf["t"].iloc[0]], "b": [pdf["b"].iloc[0]], "m": [m.tobytes()]})

    products = numbered.groupBy("k", "t", "b").applyInPandas(product, "k long, t long, b int, m binary")

    def along(pdf):                                   # a document's blocks: its length / (chunk * block) matrices
        import pandas as pd

        pdf = pdf.sort_values("b")
        found = states(unpack(pdf["m"]), 0, 0)
        return pd.DataFrame({"k": pdf["k"], "t": pdf["t"], "b": pdf["b"], "entry": found[:-1], "leave": found[1:]})

    ends = save(products.groupBy("k", "t").applyInPandas(along, "k long, t long, b int, entry int, leave int"), "block-states")

    def within(pdf):
        import pandas as pd

        pdf = pdf.sort_values("c")
        found = states(unpack(pdf["m"]), int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pd.DataFrame({"k": pdf["k"], "t": pdf["t"], "c": pdf["c"], "entry": found[:-1], "leave": found[1:]})

    resolved = numbered.join(ends, ["k", "t", "b"]).groupBy("k", "t", "b").applyInPandas(
        within, "k long, t long, c int, entry int, leave int")

    @F.pandas_udf("array<int>")
    def trace(piece, entry, leave):
        import pandas as pd

        coder = _coder(sent, key)
        texts = [p.decode("utf-8", "surrogatepass") for p in piece]
        return pd.Series([coder.trace(s, min(chunk, len(s)), int(i), int(o)) for s, i, o in zip(texts, entry, leave)])

    traced = save(chunks.join(resolved, ["k", "t", "c"]).select("k", "t", "c", trace("piece", "entry", "leave").alias("ids")), "traced")
    joined = traced.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("c", "ids"))).alias("parts"))
    joined = joined.select("k", "t", F.flatten("parts.ids").alias("ids"))
    long = named.join(joined, ["k", "t"])
    if verify:
        @F.pandas_udf("boolean")
        def same(ids, texts):
            import pandas as pd

            back = _coder(sent, key).decode
            return pd.Series([back(x.tolist()) == t for x, t in zip(ids, texts)], dtype=bool)

        long = long.withColumn("round_trip", same("ids", "text"))
    long = long.select(F.col("id").alias(id_col), *[F.col("keep")[c].alias(c) for c in keep], "ids",
                       *["round_trip"] * verify)
    return short.unionByName(long)


def decoder(spark, vocabulary: dict | None = None):
    """Column function ids -> text."""
    sent, key, _ = _send(spark, vocabulary)

    @F.pandas_udf(T.StringType())
    def decode(ids):
        import pandas as pd

        back = _coder(sent, key).decode
        return pd.Series([back(x.tolist()) if x is not None and len(x) else "" for x in ids])

    return decode
