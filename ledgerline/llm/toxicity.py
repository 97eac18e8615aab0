"""Toxicity by weak supervision.

1. Voters. Lexicon voters fire on a whole word, pattern voters on a word
   beginning; they are proposed by what the labelled texts of the bounded
   training sample have in common, next to a short list of general insults and
   shape patterns (shouting, piled up punctuation). Each votes toxic or abstains.
2. Label model. A latent label per text generates the votes. Expectation
   maximisation estimates each voter's firing rate under either label (its
   accuracy); votes that remain correlated given the label are discounted by
   their summed correlation, so that voters which fire together count once. The
   labels enter as one more, imperfect, voter whose accuracy is estimated too.
3. A logistic regression learns the posterior labels from the voters' hits and
   how many words hit; its intercept is fitted to the labels' share in the whole
   labelled table.

Only rows with a label outside the held-out fold are learned from; language,
source and id are never inputs. A text is lower-cased and split at everything
but letters; null and empty texts score like a text without hits. The score is
the regression's probability, ``predicted`` is 1 from 0.3. Without labels of
both kinds the general voters decide alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from ._util import held_out, save

#: Bounds of the fitted sample: rows of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
MAX_VOTERS, MIN_SUPPORT, MIN_LIFT = 400, 4, 30.0
#: A proposal's log likelihood ratio statistic: features that have nothing to do with the
#: label then bring only a few voters by chance, to which the regression gives little weight.
MIN_EVIDENCE = 17.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

# fixed values: general insults
INSULTS = ("idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile bastard bitch asshole "
           "dumbass retard whore slut vermin filth").split()

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def shapes_of(text: str | None) -> list[str]:
    """Pattern voters on the raw text; names are kept apart by the blank."""
    found = []
    if text:
        if text.count("!!") >= 3:
            found.append("shape shouting marks")
        letters = sum(map(str.isalpha, text)) if text.isupper() else 0
        if letters >= 20:
            found.append("shape capitals")
    return found


def features_of(text: str | None, wanted=None) -> set[str]:
    """Voters that fire: ``=word``, ``^beginning`` and shapes."""
    found = set(shapes_of(text))
    for w in words_of(text):
        found.add("=" + w)
        for k in PREFIXES:
            if len(w) > k:
                found.add("^" + w[:k])
    return found if wanted is None else found & wanted


class Model:
    """Voters with weights; a plain object that is sent to the workers."""

    def __init__(self, voters: list[str], weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias
        self.words = {v[1:]: k for k, v in enumerate(voters) if v[0] == "="}
        self.begins = {v[1:]: k for k, v in enumerate(voters) if v[0] == "^"}
        self.lengths = sorted({len(b) for b in self.begins})
        self.shapes = {v: k for k, v in enumerate(voters) if v[0] not in "=^"}
        self.shaped = set(self.shapes.values())

    def hits(self, text: str | None) -> list[int]:
        out = {self.shapes[s] for s in shapes_of(text) if s in self.shapes} if self.shapes else set()
        for w in words_of(text):
            if w in self.words:
                out.add(self.words[w])
            for k in self.lengths:
                if len(w) > k:
                    at = self.begins.get(w[:k])
                    if at is not None:
                        out.add(at)
        return sorted(out)

    def score(self, text: str | None) -> float:
        hits = self.hits(text)
        lexical = len(hits) - len(self.shaped.intersection(hits))
        z = self.bias + float(self.weights[hits].sum()) + self.weights[-1] * np.log1p(lexical)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def evidence(t: int, c: int, n_toxic: int, n_clean: int) -> float:
    """Log likelihood ratio statistic of a feature being independent of the label."""
    share = n_toxic / (n_toxic + n_clean)
    return 2 * (t * np.log(t / ((t + c) * share)) + (c * np.log(c / ((t + c) * (1 - share))) if c else 0.0)) if t else 0.0


def propose(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Voters from (feature, toxic texts, clean texts): frequent enough and
    much likelier in toxic texts, best first; a beginning that is proposed
    replaces the words and longer beginnings that it covers as well."""
    rated = []
    for f, t, c in counts:
        lift = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
        if t >= MIN_SUPPORT and lift >= MIN_LIFT and evidence(t, c, n_toxic, n_clean) >= MIN_EVIDENCE:
            rated.append((-t * np.log(lift), len(f), f))
    chosen: list[str] = []
    begins: set[str] = set()
    for _, _, f in sorted(rated):
        body = f[1:]
        if f[0] in "=^" and any(body[:k] in begins for k in PREFIXES if len(body) > k):
            continue
        chosen.append(f)
        if f[0] == "^":
            begins.add(body)
        if len(chosen) == MAX_VOTERS:
            break
    return chosen


def label_model(votes: np.ndarray, noted: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, firing rates 2 x voters) of the generative model.

    votes: texts x voters, 1 where a voter fires. noted: the given labels, one
    voter more that never abstains. Starts from the labels.
    """
    n, m = votes.shape
    q = 0.05 + 0.9 * noted
    rate = np.full((2, m), 0.5)
    weight = np.ones(m)
    for turn in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        for y, mass in ((0, 1 - q), (1, q)):
            rate[y] = (mass @ votes + 0.5) / (mass.sum() + 1)
        agree = np.clip((q * noted + (1 - q) * (1 - noted)).mean(), 0.51, 0.98)    # the labels may be wrong, too
        if turn == 2:                       # correlations that the label leaves over
            rest = votes - np.outer(1 - q, rate[0]) - np.outer(q, rate[1])
            sd = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
            corr = np.abs(rest.T @ rest / n) / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        on = np.log(rate[1] / rate[0]) * weight
        off = np.log((1 - rate[1]) / (1 - rate[0])) * weight
        z = np.log(prior / (1 - prior)) + votes @ (on - off) + off.sum() + (2 * noted - 1) * np.log(agree / (1 - agree))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, rate


def logistic(x: np.ndarray, q: np.ndarray, mass: np.ndarray, rounds: int = 40, ridge: float = 0.3):
    """Weighted ridge logistic regression on soft labels by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (mass * (p - q)) + keep * w
        curve = (a * (mass * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Fit on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows: those of
    either label with the smallest hash of their id."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y in (0, 1)").where(~held_out("id")).dropDuplicates(["id"]))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        voters = ["=" + w for w in INSULTS]
        return Model(voters, np.r_[np.full(len(voters), 4.0), 0.0], -3.0)
    picks = None
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picks = part if picks is None else picks.unionAll(part)
    picks = save(picks, "toxic-sample")                       # a bounded table: at most the two limits
    sample = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(picks), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    sample = save(sample, "toxic-texts")

    def count(batches):
        import pandas as pd

        tally: Counter = Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                tally.update((f, int(y)) for f in features_of(text if isinstance(text, str) else None))
        if tally:
            yield pd.DataFrame([(f, n if y else 0, 0 if y else n) for (f, y), n in tally.items()], columns=["f", "t", "c"])

    # copies of a text would make evidence of its rare words: voters are proposed from one text per bucket
    prints = near_dedup.fingerprints(sample, 2, "id", "text").where("n > 0")
    buckets = save(near_dedup.unpack(prints.select("id", F.col("n").alias("size"), "bands")), "toxic-buckets")
    first = buckets.groupBy(F.col("bucket").alias("b")).agg(F.min("id").alias("first"))
    copies = buckets.join(first, F.col("bucket").eqNullSafe(F.col("b"))).where("id > first").select("id").distinct()
    apart = save(sample.join(copies, "id", "left_anti"), "toxic-apart")
    sums = (apart.mapInPandas(count, "f string, t long, c long").groupBy("f")
            .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_SUPPORT))
    n = {y: max(1, c) for y, c in ((r["y"], r["n"]) for r in apart.groupBy("y").agg(F.count("*").alias("n")).collect())}
    n_toxic, n_clean = n.get(1, 1), n.get(0, 1)
    lift = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1))
    likely = sums.where(lift >= MIN_LIFT).orderBy(F.desc(F.col("t") * F.log(lift)), "f").limit(20 * MAX_VOTERS)
    voters = propose([(r["f"], r["t"], r["c"]) for r in likely.collect()], n_toxic, n_clean)
    voters += [v for v in (["=" + w for w in INSULTS] + ["shape shouting marks", "shape capitals"]) if v not in voters]

    blank = Model(voters, np.zeros(len(voters) + 1), 0.0)

    @F.pandas_udf("array<int>")
    def hits(text):
        import pandas as pd

        return pd.Series([blank.hits(t) for t in text.where(text.notna(), None)])

    rows = sample.select("id", "y", hits("text").alias("hits")).collect()      # hit lists of the bounded sample
    rows.sort(key=lambda r: r["id"])
    votes = np.zeros((len(rows), len(voters)))
    for k, r in enumerate(rows):
        votes[k, r["hits"]] = 1
    noted = np.array([r["y"] for r in rows], float)
    posterior, _ = label_model(votes, noted)
    lexical = [k for k in range(len(voters)) if k not in blank.shaped]
    x = np.column_stack([votes, np.log1p(votes[:, lexical].sum(axis=1))])
    share = {1: totals[1] / max(1, noted.sum()), 0: totals[0] / max(1, (1 - noted).sum())}
    mass = np.where(noted > 0, share[1], share[0])
    mass = mass * len(mass) / mass.sum()                       # the labelled table's shares, the sample's size
    weights, bias = logistic(x, posterior, mass)
    return Model(voters, weights, bias)


def scorer(model: Model):
    """Column function text -> score."""

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series([model.score(t) for t in text.where(text.notna(), None)], dtype=float)

    return score


def score_texts(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    score = scorer(model)
    return (df.select(F.col(id_col), held_out(id_col).alias("_h"), score(F.col(text_col)).alias("_s"))
            .select(id_col, F.col("_h").alias("held_out"), F.col("_s").alias("score"),
                    (F.col("_s") >= THRESHOLD).cast("int").alias("predicted")))
