"""Language ID by cross-parsing entropy.

Training text of each language (the same number of first characters of every
document of a bounded sample) is indexed by a suffix automaton. A document is parsed greedily into phrases, each
the longest match that occurs in the training text; the entropy estimate of a
language is ``phrases * log2(training length) / characters`` and the language
with the lowest one wins (ties: the alphabetically first).

Text is lower-cased, everything but letters becomes one space. Parsing runs
over the whole text in blocks of ``BLOCK`` characters (a phrase ends with its
block), all blocks and languages of a batch in step, so a very long document
costs as much per character as a short one. Null texts and texts without a
letter give ``und`` with score 0. Without any training row every text is
``und``. The score is ``1 - H(best) / H(second)``; 1 if one language is known.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import held_out, one_model, save

#: Bounds of the fitted sample: documents per language, characters per language
#: (after normalisation), characters in total (shared when languages are many).
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_TOTAL = 64, 60_000, 400_000
BLOCK = 1024
_GROUP = 2_000_000          # characters parsed at once

UNDETERMINED = "und"
_letters = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def normalise(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one space."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def build_automaton(codes: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton, states x alphabet; where a state
    has no transition, the bitwise complement of the root's (a phrase ends and
    the next one starts with this character). A character that the text lacks
    is a phrase of its own."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    # one more state after the last: behind a character the training text lacks
    table = np.empty((len(edges) + 1, alphabet), np.int32)
    root = np.full(alphabet, len(edges), np.int32)
    for c, to in edges[0].items():
        root[c] = to
    table[:] = ~root
    for state, out in enumerate(edges):
        if out:
            table[state, list(out)] = list(out.values())
    return table


def language_share(languages: int) -> int:
    """Characters per language."""
    return min(TRAIN_CHARS, TRAIN_TOTAL // max(1, languages))


def equal_cut(lengths: list[int], total: int) -> int:
    """Largest cut with which texts of these lengths, each cut to it and with a
    space behind, have at most ``total`` characters: what short texts leave
    goes to the longer ones."""
    left = total - len(lengths)
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) >= left:
            return max(0, left // (len(lengths) - k))
        left -= n
    return max(lengths, default=0)


class CrossParser:
    """Automata of all languages in one table, built from training texts."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        texts = [normalise(training[x]) for x in self.languages]
        texts = [t[:language_share(len(texts))] for t in texts]
        points = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        self.code = np.zeros(0x110000, np.int32)            # 0: in no training text
        self.code[points] = np.arange(1, len(points) + 1)
        self.width = len(points) + 1
        tables, self.roots, at = [], [], 0
        for t in texts:
            table = build_automaton(self.code[t].tolist(), self.width)
            tables.append(np.where(table < 0, ~(~table + at), table + at).astype(np.int32))
            self.roots.append(at)
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32)
        self.bits = np.log2(np.maximum([len(t) for t in texts], 2)) if texts else np.zeros(0)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, languages x texts."""
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        owner, start, size = [], [], []
        for k, t in enumerate(texts):
            for s in range(0, len(t), BLOCK):
                owner.append(k)
                start.append(s)
                size.append(min(BLOCK, len(t) - s))
        if not owner:
            return counts
        order = np.argsort(-np.array(size), kind="stable")
        owner, size = np.array(owner)[order], np.array(size)[order]
        codes = np.zeros((BLOCK, len(order)), np.int32)
        for lane, k in enumerate(order.tolist()):
            piece = self.code[texts[owner[lane]][start[k]: start[k] + size[lane]]]
            codes[: len(piece), lane] = piece
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        ended = np.ones((len(self.languages), len(order)), np.int32)   # the block's last phrase
        alive = len(order)
        for step in range(int(size[0])):
            while size[alive - 1] <= step:
                alive -= 1
            to = self.table[state[:, :alive] * np.int64(self.width) + codes[step, :alive]]
            miss = to >> 31                                   # -1 where a phrase ended
            if step:
                ended[:, :alive] -= miss
            state[:, :alive] = to ^ miss
        for lang in range(len(self.languages)):
            counts[lang] = np.bincount(owner, ended[lang], len(texts)).astype(np.int64)
        return counts

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """(language, score) of raw texts."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return langs, scores
        group, held, at = [], 0, 0
        for k, text in enumerate(texts):
            group.append(normalise(text))
            held += len(group[-1])
            if held >= _GROUP or k == len(texts) - 1:
                lengths = np.array([len(t) for t in group])
                entropy = self.phrases(group) * self.bits[:, None] / np.maximum(lengths, 1)
                best = entropy.argmin(axis=0)
                ranked = np.sort(entropy, axis=0)
                for j in np.flatnonzero(lengths):
                    langs[at + j] = self.languages[best[j]]
                    scores[at + j] = 1.0 if len(ranked) == 1 else 1 - ranked[0, j] / ranked[1, j]
                at += len(group)
                group, held = [], 0
        return langs, scores


def training_texts(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, str]:
    """The beginnings of at most ``TRAIN_DOCUMENTS`` documents per language,
    joined by spaces: of each language's rows in every one of that many hash
    buckets the one with the smallest hash. Only rows outside the held-out fold,
    with id, text and language. Runs of other characters than letters and digits
    are one space. All documents of a language are cut to one length, so that together
    they have at most its share of characters; they are cut before they are
    collected. The result is bounded by the number of languages."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null").where(~held_out("id"))
    spread = F.xxhash64(F.col("id"))
    picks = (rows.select("lang", "id", F.pmod(spread, F.lit(TRAIN_DOCUMENTS)).alias("bucket"), spread.alias("h"))
             .groupBy("lang", "bucket").agg(F.min(F.struct("h", "id")).alias("m")).select("lang", F.col("m.id").alias("id")))
    wanted = [r["id"] for r in picks.collect()]             # <= TRAIN_DOCUMENTS ids per language
    if not wanted:
        return {}
    found = rows.where(F.col("id").isin(wanted)).groupBy("id", "lang").agg(F.min("text").alias("text"))
    found = save(found.select("id", "lang", F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ").alias("text")), "language-training")
    lengths: dict[str, list[int]] = {}
    for r in found.select("lang", F.length("text").alias("n")).collect():
        lengths.setdefault(r["lang"], []).append(r["n"])
    total = language_share(len(lengths))
    cuts = [(lang, equal_cut(n, total)) for lang, n in lengths.items()]
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts for x in pair]), F.col("lang"))
    out: dict[str, list[str]] = {}
    for r in sorted(found.select("id", "lang", F.substring("text", F.lit(1), cut).alias("text")).collect(),
                    key=lambda r: (r["lang"], r["id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(texts) for lang, texts in out.items()}


def predictor(spark, training: dict[str, str]):
    """Column function text -> struct(lang_pred, score). Only the training
    texts are sent; each Python worker builds the automata once."""
    sent = spark.sparkContext.broadcast(training)
    key = hash(tuple(sorted(training.items())))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text):
        import pandas as pd

        from ledgerline.llm import language_id as module

        parser = module.one_model("language_id", key, lambda: module.CrossParser(sent.value))
        lang, score = parser.predict(text.where(text.notna(), None).tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def identify(df: DataFrame, training: dict[str, str] | None = None, id_col="doc_id", text_col="text",
             lang_col="lang") -> DataFrame:
    """id, held_out, lang_pred, score for every row of ``df``."""
    training = training_texts(df, id_col, text_col, lang_col) if training is None else training
    predict = predictor(df.sparkSession, training)
    return (df.select(F.col(id_col), held_out(id_col).alias("_held"), predict(F.col(text_col)).alias("_p"))
            .select(id_col, F.col("_held").alias("held_out"), "_p.lang_pred", "_p.score"))
