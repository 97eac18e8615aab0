import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fill_in_middle as fim
from ledgerline.llm import oracle, queries

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", " a", "a ", "  a\tb \n", "x\r\ny\x0bz", "über 😀 naïve wort x", "<P> here", "a <", "S> b <S", "\x00\x1f",
       "a<M>b", "one\n\ntwo\n", " \n ", "word " * 3000, "é" * 5000]


def brute(ident, text, seed=42):
    text = text or ""
    words = TOKEN.findall(text)
    assert "".join(words) == text
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(words)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return (n, "plain", None, None, text)
    prefix, middle, suffix = ("".join(words[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 16, n).astype(np.uint8)
        m = fim.WaveletMatrix(x, 4)
        at = np.arange(n + 1)
        for s in range(16):
            want = np.concatenate([[0], np.cumsum(x == s)])
            assert (m.rank(s, at) == want).all()
            places = np.flatnonzero(x == s)
            assert (m.select(s, np.arange(len(places))) == places).all()
        assert (m.access(np.arange(n)) == x).all()


@pytest.mark.parametrize("unit", ["word", "line", "char"])
def test_counts_and_cuts(unit):
    split = {"word": TOKEN.findall, "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "char": list}[unit]
    bounds = fim.Boundaries(ODD, unit)
    assert bounds.n.tolist() == [len(split(t)) for t in ODD]
    for share in (0.0, 0.3, 0.5, 1.0):
        units = (bounds.n * share).astype(np.int64)
        want = [len("".join(split(t)[:u])) for t, u in zip(ODD, units)]
        assert bounds.cut(units).tolist() == want
        assert (bounds.count(bounds.cut(units)) == units).all()


def test_against_brute_force():
    texts = ODD * 40
    ids = list(range(len(texts)))
    assert fim.transform_texts(ids, texts) == [brute(i, t) for i, t in zip(ids, texts)]
    forms = {r[1] for r in fim.transform_texts(ids, texts)}
    assert forms == {"plain", "psm", "spm"}


def test_runs(monkeypatch):
    monkeypatch.setattr(fim, "RUN_CHARS", 10)
    texts = ["", "abc", "defghijk", "x" * 30, "", "y", "z" * 10]
    parts = list(fim.runs(texts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(7))
    assert all(p.stop - p.start == 1 or sum(map(len, texts[p])) <= 10 for p in parts)
    ids = list(range(7))
    assert fim.transform_texts(ids, texts) == [brute(i, t) for i, t in zip(ids, texts)]
    assert list(fim.runs([])) == []


def test_rows_and_round_trip(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(ODD * 3)] + [(None, "some text of no id", "n", 2), (None, None, None, None),
                                                              (7, None, "x", 1), (5, "a b c", "x", 1), (5, "a b c", "x", 1)]
    rows += [(900 + i, "long words " * 120_000, "x", i) for i in range(4)]     # longer than a run
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    made = fim.fill_in_middle(df)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *map(str, brute(i, t)), t or "") for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), str(r["n"]), r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"])
                  for r in got) == want
    empty = fim.fill_in_middle(df.limit(0))
    assert empty.collect() == [] and empty.schema == made.schema
    kept = fim.fill_in_middle(df.withColumnRenamed("n", "output_"), keep=("output_",))
    assert kept.columns[:2] == ["doc_id", "output_"]
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="page")


def test_other_units_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(ODD * 5)), "doc_id long, text string")
    for unit in ("line", "char"):
        made = fim.fill_in_middle(df, unit, seed=3).withColumn("back", fim.restore(F.col("output"), F.col("form")))
        assert made.join(df, "doc_id").where("back <> text").count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(oracle.fill_in_middle_sql()).fetchall()
    got = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[2] for r in want}) == 3
