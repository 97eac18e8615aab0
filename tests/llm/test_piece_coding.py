import functools
import random

import numpy as np
import pytest

from ledgerline.llm import piece_coding as P
from ledgerline.llm import queries
from ledgerline.llm._util import read

rng = random.Random(4)


@pytest.fixture(scope="module")
def vocabulary():
    return P.load_vocabulary()


def small(mark_inside=False):
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "abab", "▁a", "▁ab", "bb"] + (["b▁a"] if mark_inside else [])
    return {"pieces": {p: (300 + k, -(1000 + 137 * k * k % 911)) for k, p in enumerate(pieces)}, "bytes": [(b, -5000) for b in range(256)]}


def best_score(vocabulary, text):
    """Best segmentation score, plain Viterbi over the whole text."""
    coder = P.Coder(vocabulary)
    s = coder.marked(text)
    best = [0] + [None] * len(s)
    for i in range(len(s)):
        for j, score, _ in coder._edges(s, i):
            if best[j] is None or best[i] + score > best[j]:
                best[j] = best[i] + score
    return best[-1]


def score_of(vocabulary, ids):
    scores = {i: s for i, s in vocabulary["pieces"].values()} | dict(vocabulary["bytes"])
    return sum(scores[i] for i in ids)


@pytest.mark.parametrize("inside", [False, True])
def test_every_split_gives_the_best_path(inside):
    voc = small(inside)
    coder = P.Coder(voc)
    n = coder.longest
    for case in range(80):
        text = "".join(rng.choice("ab  c\n" if case % 2 else "ab") for _ in range(rng.randint(1, 60)))
        assert score_of(voc, coder.encode(text)) == best_score(voc, text)
        assert coder.decode(coder.encode(text)) == text
        s, size = coder.marked(text), rng.randint(2 * n, 20)
        cuts = [s[k: k + size + n - 1] for k in range(0, len(s), size)]
        sizes = [min(size, len(s) - k) for k in range(0, len(s), size)]
        ms = [coder.matrix(c, m) for c, m in zip(cuts, sizes)]
        found = P.states(ms, 0, 0)
        ids = np.concatenate([coder.trace(c, m, i, o) for c, m, i, o in zip(cuts, sizes, found, found[1:])])
        assert score_of(voc, ids) == best_score(voc, text) == functools.reduce(P.max_plus, ms)[0, 0]
        assert coder.decode(ids.tolist()) == text
        if len(ms) > 2:
            assert (P.max_plus(P.max_plus(ms[0], ms[1]), ms[2]) == P.max_plus(ms[0], P.max_plus(ms[1], ms[2]))).all()


def test_whole_table_round_trip(spark, vocabulary):
    texts = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    coder = P.Coder(vocabulary)
    rows = queries.op8_piece_coding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows[:150]:
        assert coder.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert score_of(vocabulary, r["ids"]) == best_score(vocabulary, texts[r["doc_id"]])


def test_long_texts_in_chunks(spark, vocabulary):
    texts = ["word " * 300, "x" * 700 + " y", "日本語 ▁ text\n\n" * 60, " lead  and  trail ", "a▁b", "", None,
             "".join(rng.choice("ab \n") for _ in range(999)), "z" * 100]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, ids int")
    got = P.encode(df, vocabulary, chunk=100, block=2).collect()
    decode = P.Coder(vocabulary).decode
    assert len(got) == len(texts) + 1
    by = {r["doc_id"]: r["ids"] for r in got}
    for i, t in enumerate(texts):
        ids = by[i if i else None]
        assert decode(ids) == (t or "") if ids else not t
        if t:
            assert score_of(vocabulary, ids) == best_score(vocabulary, t)
    assert P.encode(df.limit(0), vocabulary).collect() == []
    back = P.encode(df, vocabulary).withColumn("back", P.decoder(spark, vocabulary)("ids")).collect()
    assert sorted(r["back"] for r in back) == sorted([t or "" for t in texts] + [texts[3]])
    with pytest.raises(ValueError):
        P.encode(df, vocabulary, chunk=10)
