import zlib

import numpy as np

from ledgerline.llm import queries
from ledgerline.llm import toxicity as X
from ledgerline.llm._util import read


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["toxic"] for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = {r["doc_id"]: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(rows) == 10_000
    held = [(truth[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in truth]
    caught = sum(t and p for t, p in held) / sum(t for t, _ in held)
    false = sum(p and not t for t, p in held) / sum(not t for t, _ in held)
    assert caught > 0.9 and false < 0.005, (caught, false)    # some labels are noise
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.2
    rates = np.array([[0.01, 0.05, 0.02], [0.6, 0.5, 0.3]])
    votes = (rng.random((6000, 3)) < rates[truth.astype(int)]).astype(float)
    noted = np.where(rng.random(6000) < 0.95, truth, ~truth).astype(float)        # labels are wrong now and then
    q, rate = X.label_model(votes, noted)
    assert np.abs(rate - rates).max() < 0.08
    assert ((q > 0.5) == truth).mean() > ((noted > 0.5) == truth).mean()
    twice, _ = X.label_model(np.column_stack([votes, votes[:, 0], votes[:, 0]]), noted)   # copies of a voter count once
    assert np.abs(twice - q).mean() < 0.05


def test_proposals_prefer_the_covering_beginning():
    counts = [("^lowe", 90, 0), ("^lowei", 85, 0), ("=loweix", 20, 0), ("=idiot", 50, 0), ("=the", 100, 800), ("=rare", 2, 0)]
    assert X.propose(counts, 100, 1000) == ["^lowe", "=idiot"]


def test_learns_only_from_allowed_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "fine badword text" if i in held else f"fine text nr {i}") for i in range(400)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in held or i % 7 == 0)) for i in range(400)], "doc_id long, toxic int")
    assert "=badword" not in X.fit(docs, labels).voters


def test_odd_rows(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "IDIOT!"), (4, "fine " * 100_000 + "scum")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels)
    got = [(r["doc_id"], r["predicted"]) for r in X.score_texts(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, 1)], key=str)
    assert X.score_texts(docs.limit(0), model).collect() == []
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (77, 0)], "doc_id long, toxic int")
    assert len(X.score_texts(docs, X.fit(docs, some)).collect()) == 6
