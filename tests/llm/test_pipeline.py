"""The pipeline against brute-force versions of its stages on a small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from ledgerline.llm import decontamination, language_id, piece_coding  # noqa: E402
from ledgerline.llm._util import read  # noqa: E402
from tests.llm.test_decontamination import brute_distance  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_line_dedup import form  # noqa: E402
from tests.llm.test_near_dedup import brute as brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs = read(spark, SF, "documents").limit(24)
    item = read(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    words = " ".join(f"word{i}" for i in range(80))
    extra = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 456\n7", "en", "s", 9), (9004, words, "en", "s", 1),
         (9005, words.replace("word40", "other"), None, None, 1), (9006, f"some text before {item} and after", "en", "s", 1),
         (9007, " ".join(words.split()[::-1]) + "\nends here", "en", "s", 1)], docs.schema)
    docs.unionByName(extra).write.parquet(str(folder / "documents.parquet"))
    read(spark, SF, "benchmark").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "pieces"]


def test_against_brute_force(spark, table):
    rows = sorted((r["doc_id"], r["text"]) for r in read(spark, table, "documents").collect() if r["text"])
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t)]
    lines = brute_lines(kept)
    kept = [(i, new) for (i, _), new in zip(kept, lines) if any(form(x) for x in new.split("\n"))]
    near = brute_near(dict(kept), 5)
    kept = [(i, t) for i, t in kept if near[i] == i]
    items = [decontamination.normalise(r["text"]) for r in read(spark, table, "benchmark").collect()]
    segs = [s.tobytes() for x in items for _, s in decontamination.segments(x)]

    def leaks(text):
        flat = decontamination.normalise(text).tobytes()
        return any(s in flat or (set(s[k:k + 8] for k in range(0, len(s), 9)) & set(flat[k:k + 8] for k in range(len(flat)))
                                 and brute_distance(s, flat) <= decontamination.budget(len(s))) for s in segs)

    kept = [(i, t) for i, t in kept if not leaks(t)]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, table).collect()}
    assert sorted(out) == [i for i, _ in kept]
    assert 9004 in out and not {9001, 9002, 9003, 9005, 9006} & set(out)
    decode = piece_coding.Coder(piece_coding.load_vocabulary()).decode
    for i, t in kept:
        assert decode(out[i]["ids"]) == t and out[i]["n_tokens"] == len(out[i]["ids"])


def test_columns_and_empty_table(spark, table):
    docs = read(spark, table, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, table)
        assert out.collect() == []
        if name != "pieces":
            assert out.columns == docs.columns
            docs = out
    assert language_id.UNDETERMINED == "und"


def test_a_worker_holds_one_model():
    from ledgerline.llm import _util

    built = []
    make = lambda name: lambda: built.append(name) or name
    assert [_util.one_model("a", 1, make("x")), _util.one_model("a", 1, make("y")), _util.one_model("b", 1, make("z"))] == ["x", "x", "z"]
    assert list(_util._held) == [("b", 1)] and built == ["x", "z"]
    assert _util.one_model("a", 1, make("again")) == "again"


def test_vocabularies_that_differ_late_have_their_own_keys(spark):
    words = piece_coding.load_vocabulary()
    other = {"pieces": dict(words["pieces"]), "bytes": words["bytes"]}
    last = max(other["pieces"])
    other["pieces"][last] = (other["pieces"][last][0], other["pieces"][last][1] + 1)
    assert piece_coding._send(spark, words)[1] != piece_coding._send(spark, other)[1]
    assert piece_coding._send(spark, words)[1] == piece_coding._send(spark, dict(words))[1]
