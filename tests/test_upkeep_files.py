"""Addresses, file-level compaction with its journal, snapshot expiry by reachability, safe deletion."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.addresses import ANY_SPELLING, canonical, folder
from ledgerline.plans import compaction, maintenance
from ledgerline.session import fresh_path
from ledgerline.sources import files as file_source

OLD = dt.datetime(2020, 1, 1)


def spelt(spark, address, **options):
    return spark.createDataFrame([(address,)], "a string").select(canonical("a", **options)).first()[0]


@pytest.mark.parametrize("address, want", [
    ("/x/y", "file:///x/y"), ("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y"), ("FILE:////x//y/", "file:///x/y"),
    ("/x/./y/././z", "file:///x/y/z"), ("s3://Bucket/a//b", "s3a://bucket/a/b"), ("s3n://b/k", "s3a://b/k"), ("s3a://b", "s3a://b"),
    ("hdfs://NN:8020/d/f", "hdfs://nn/d/f"), ("hdfs://nn:9000/d", "hdfs://nn:9000/d"), ("abfs://c@a/d", "abfss://c@a/d"),
    ("rel/f", "file:///rel/f"), ("/", "file:///"), ("/k=a:b/f", "file:///k=a:b/f"), (None, None), ("/a\nb", "file:///a\nb")])
def test_canonical_addresses(spark, address, want):
    assert spelt(spark, address) == want


def test_escapes_and_default_filesystem(spark):
    assert spelt(spark, "file:/t/k=a%252Fb%20c/f", escapes=1) == spelt(spark, "/t/k=a%2Fb c/f")
    every = {spelt(spark, a, escapes=ANY_SPELLING) for a in ("/k=a%2Fb c+d", "file:///k=a%252Fb%20c+d", "file:/k=a/b c+d")}
    assert every == {"file:///k=a/b c+d"}
    assert spelt(spark, "/100%/x%zz", escapes=ANY_SPELLING) == "file:///100%/x%zz"
    on_hdfs = {spelt(spark, a, default_scheme="hdfs", default_authority="nn") for a in ("/d/f", "hdfs:/d/f", "hdfs:///d/f", "hdfs://nn:8020/d/f")}
    assert on_hdfs == {"hdfs://nn/d/f"}
    assert spark.range(1).select(folder(F.lit("s3a://b/d/f"))).first()[0] == "s3a://b/d"


def test_canonical_form_stays_in_generated_code(spark, capfd):
    df = spark.createDataFrame([(f"s3://b/x%20{i}/",) for i in range(50)], "a string").repartition(2)
    assert df.select(canonical("a", ANY_SPELLING).alias("c")).distinct().count() == 50
    assert "CompileException" not in capfd.readouterr().err


# ---------------------------------------------------------------- orphans

SPELL = [lambda p: p, lambda p: "file:" + p, lambda p: "file://" + p, lambda p: "file:" + p.replace(" ", "%20"),
         lambda p: p.replace("/t/", "//t/./")]


def test_spellings_give_the_same_orphans(spark):
    live = [f"/w/t/k={i % 3}/part a-{i}" for i in range(12)]
    stored = live + [f"/w/t/k={i}/gone {i}" for i in range(3)]
    for turn in range(5):
        files = spark.createDataFrame([(SPELL[(i + turn) % 5](p), p, OLD) for i, p in enumerate(stored)], "path string, p string, m timestamp")
        refs = spark.createDataFrame([(SPELL[(i * turn) % 5](p),) for i, p in enumerate(live)], "path string")
        got = maintenance.orphan_files(files, refs, "path", "path", "m")
        assert got.columns == ["path", "p", "m"] and {r.p for r in got.collect()} == set(stored[12:])


def test_listings_of_another_place_are_refused(spark):
    files = spark.createDataFrame([("s3://bucket/t/k=1/a", OLD)], "path string, m timestamp")
    refs = spark.createDataFrame([("file:/t/k=1/a",)], "path string")
    with pytest.raises(maintenance.ForeignListing):
        maintenance.orphan_files(files, refs, "path", "path", "m")
    with pytest.raises(maintenance.ForeignListing):
        maintenance.orphan_files(files, refs.limit(0), "path", "path", "m")
    assert maintenance.orphan_files(files.limit(0), refs, "path", "path", "m").collect() == []
    same = spark.createDataFrame([("s3a://BUCKET/t/k=1/b",)], "path string")
    assert maintenance.orphan_files(files, same, "path", "path", "m").count() == 1


def test_live_files_are_not_deleted(spark, tmp_path):
    for n in ("a b", "c"):
        (tmp_path / n).write_text(n)
    report = spark.createDataFrame([(f"{tmp_path}/a b",), (f"{tmp_path}/c",)], "path string")
    live = spark.createDataFrame([(f"file://{tmp_path}/a%20b",)], "path string")
    with pytest.raises(ValueError, match="live"):
        maintenance.delete_files(report, live)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a b", "c"]
    done = {os.path.basename(r.path): r.deleted for r in maintenance.delete_files(report.where("path like '%c'"), live).collect()}
    assert done == {"c": True} and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a b"]
    assert maintenance.delete_files(report.limit(0), live).collect() == []


def small_table(spark, name, files=6, rows=600, parts=3):
    path = fresh_path(spark, name)
    spark.range(rows).selectExpr("id", "sha2(cast(id as string), 256) body", f"concat('p ', id % {parts}) k").repartition(
        files, "id").write.partitionBy("k").parquet(path)
    return path


def names(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs
                  if f.endswith(".parquet") and compaction.RUN not in d)


def content(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "body", "k").collect()))


def test_orphans_are_removed_unattended(spark, tmp_path):
    path = small_table(spark, "attended")
    before, rows = names(path), content(spark, path)
    junk = os.path.join(os.path.dirname(before[0]), "left over.parquet.tmp")
    open(junk, "w").write("x")
    outside = tmp_path / "elsewhere"
    outside.write_text("x")
    files = spark.createDataFrame([(f"file://{p.replace(' ', '%20')}", OLD) for p in before] + [(junk, OLD), (str(outside), OLD)],
                                  "path string, modified_at timestamp")
    done = maintenance.remove_orphans(spark, path, "k", files).collect()
    assert [(r.path, r.deleted) for r in done] == [(junk, True)]
    assert names(path) == before and content(spark, path) == rows and outside.exists()


# ---------------------------------------------------------------- bins

def brute_bins(files, threshold, target):
    out, line = {}, {}
    for part, path, size in sorted(files, key=lambda f: (str(f[0]), f[1])):
        if size < threshold:
            line.setdefault(part, []).append((path, size))
    for part, members in line.items():
        before, bins = 0, {}
        for path, size in members:
            bins.setdefault(before // target, []).append((path, size))
            before += size
        out |= {(part, p): (b, len(m), sum(s for _, s in m)) for b, m in bins.items() if len(m) > 1 for p, _ in m}
    return out


def test_bins_against_brute_force(spark):
    rng = random.Random(1)
    files = [(rng.choice(["a", "b", None, "c"]), f"f{i:04}", rng.choice([0, 5, 40, 99, 100, 5000])) for i in range(400)]
    files.append(("lonely", "f", 1))
    df = spark.createDataFrame(files, "p string, path string, size long")
    got = maintenance.compaction_bins(df, "p", "path", "size", 100, 250).collect()
    assert {(r.p, r.path): (r.bin, r.bin_files, r.bin_bytes) for r in got} == brute_bins(files, 100, 250)


def test_many_files_are_packed_in_parallel(spark, monkeypatch):
    monkeypatch.setattr(compaction, "GROUP_FILES", 50)
    df = spark.range(1000).selectExpr("'hot' p", "concat('f', id) path", "id % 90 size")
    got = maintenance.compaction_bins(df, "p", "path", "size", 100, 300)
    assert got.select("pack").distinct().count() == 20
    bins = got.groupBy("pack", "bin").agg(F.sum("size").alias("s"), F.first("bin_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.s == r.b < 300 + 100 and r.n > 1 for r in bins)
    assert got.count() > 950 and got.select("path").distinct().count() == got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


# ---------------------------------------------------------------- rewrite

def test_large_files_are_neither_read_nor_touched(spark):
    path = small_table(spark, "mixed", files=5)
    big = fresh_path(spark, "big")
    spark.range(5000, 45_000).selectExpr("id", "sha2(cast(id as string), 512) body", "'p 0' k").coalesce(1).write.partitionBy("k").parquet(big)
    source = names(big)[0]
    target = os.path.join(path, "k=p 0", "large.parquet")
    size = os.path.getsize(source)
    broken = os.urandom(size)                             # reading it would fail
    open(target, "wb").write(broken)
    alone = os.path.join(path, "k=q")                     # a partition with one small file: not read either
    os.mkdir(alone)
    open(os.path.join(alone, "one.parquet"), "wb").write(b"not parquet")
    plan = {r.k: r for r in maintenance.compact_table(spark, path, "k", threshold=size // 2, target=size).collect()}
    assert set(plan) == {"p 0", "p 1", "p 2"}
    assert plan["p 0"].total_files == 6 and plan["p 0"].rewritten_files == 5 and plan["p 0"].n_files == 2
    assert open(target, "rb").read() == broken
    os.remove(target)
    os.remove(os.path.join(alone, "one.parquet"))
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == 600 and len(names(path)) == 3


def test_batches_and_packing_keep_every_row(spark):
    path = small_table(spark, "batched", files=8, rows=4000, parts=4)
    rows = content(spark, path)
    size = max(os.path.getsize(f) for f in names(path))
    plan = maintenance.compact_table(spark, path, "k", threshold=size + 1, target=int(2.5 * size), batch_files=5).collect()
    assert len(plan) == 4 and all(r.new_files in (2, 3, 4) for r in plan)
    assert content(spark, path) == rows
    assert len(names(path)) == sum(r.n_files for r in plan)
    assert not [d for d in os.listdir(path) if d.startswith("_") and d != "_SUCCESS"]


def test_empty_files_and_clashing_columns(spark):
    path = fresh_path(spark, "clash")
    spark.range(20).selectExpr("id", "id __bin", "id __from", "id __uri", "map('a', id) m", "'x' k").repartition(3).write.partitionBy("k").parquet(path)
    empty = fresh_path(spark, "none")
    spark.range(5).selectExpr("id", "id __bin", "id __from", "id __uri", "map('a', id) m").where("id < 0").coalesce(1).write.parquet(empty)
    for i in range(2):
        os.makedirs(f"{path}/k=void", exist_ok=True)
        data = open(names(empty)[0], "rb").read()
        open(f"{path}/k=void/e{i}.parquet", "wb").write(data)
    maintenance.compact_table(spark, path, "k")
    back = spark.read.parquet(path)
    assert back.count() == 20 and back.where("__bin = id and __from = id and __uri = id and m['a'] = id").count() == 20


class Killed(Exception):
    pass


def killed_after(monkeypatch, moves):
    real, left = compaction._move, [moves]

    def move(fs, source, target):
        if fs.exists(source):
            if not left[0]:
                raise Killed
            left[0] -= 1
        return real(fs, source, target)

    monkeypatch.setattr(compaction, "_move", move)


def test_a_killed_run_is_finished_by_the_next(spark, monkeypatch):
    path = small_table(spark, "template", files=3, rows=90, parts=2)
    rows, moves = content(spark, path), 2 * (3 + 1)
    import shutil
    for k in range(moves):
        copy = fresh_path(spark, f"killed-{k}")
        shutil.copytree(path, copy)
        with monkeypatch.context() as m:
            killed_after(m, k)
            with pytest.raises(Killed):
                maintenance.compact_table(spark, copy, "k", threads=1)
        with monkeypatch.context() as m:                  # the repair is killed as well, somewhere else
            killed_after(m, (moves - k) // 2)
            try:
                maintenance.recover(spark, copy)
            except Killed:
                pass
        assert maintenance.compact_table(spark, copy, "k").collect() == []
        assert content(spark, copy) == rows, k
        assert len(names(copy)) == 2 and not [d for d in os.listdir(copy) if d.startswith(compaction.RUN)]
        assert maintenance.recover(spark, copy) == {"finished": 0, "discarded": 0}


def test_a_run_killed_before_its_journal_is_discarded(spark, monkeypatch):
    path = small_table(spark, "early", files=3, rows=90)
    before, rows = names(path), content(spark, path)

    def stop(*args):
        raise Killed

    for step in ("_write_text", "_compare"):
        with monkeypatch.context() as m:
            m.setattr(compaction, step, stop)
            with pytest.raises(Killed):
                maintenance.compact_table(spark, path, "k")
        assert names(path) == before and content(spark, path) == rows
    assert maintenance.recover(spark, path) == {"finished": 0, "discarded": 1}
    # a batch that was closed but not cleaned away
    run = f"{path}/{compaction.RUN}x"
    os.makedirs(run)
    open(f"{run}/done", "w").write("")
    assert maintenance.recover(spark, path) == {"finished": 0, "discarded": 1}
    assert maintenance.recover(spark, path + "-none") == {"finished": 0, "discarded": 0}


def test_lost_staged_files_stop_the_replay(spark, monkeypatch):
    path = small_table(spark, "lost", files=3, rows=90, parts=1)
    rows = content(spark, path)
    with monkeypatch.context() as m:
        killed_after(m, 0)
        with pytest.raises(Killed):
            maintenance.compact_table(spark, path, "k", threads=1)
    run = next(os.path.join(path, d) for d in os.listdir(path) if d.startswith(compaction.RUN))
    staged = [os.path.join(d, f) for d, _, fs in os.walk(f"{run}/new") for f in fs if f.endswith(".parquet")]
    os.remove(staged[0])
    with pytest.raises(RuntimeError, match="neither staged nor in place"):
        maintenance.recover(spark, path)
    assert content(spark, path) == rows


# ---------------------------------------------------------------- snapshots

def brute_expired(manifest, expired):
    live = {p for t, s, p, _ in manifest if (t, s) not in expired}
    out = {}
    for t, s, p, n in manifest:
        if (t, s) in expired and p not in live:
            held, size = out.get((t, p), (set(), 0))
            out[t, p] = (held | {s}, max(size, n))
    return {k: (size, len(held)) for k, (held, size) in out.items()}


def test_files_of_expired_snapshots_against_brute_force(spark):
    rng = random.Random(2)
    manifest = [(f"t{rng.randrange(3)}", rng.randrange(12), f"/w/f{rng.randrange(60)}", rng.randrange(1, 9)) for _ in range(300)]
    expired = {(t, s) for t, s, _, _ in manifest if s < 7}
    m = spark.createDataFrame(manifest, "table_name string, snapshot_id int, path string, length long")
    e = spark.createDataFrame(sorted(expired), "table_name string, snapshot_id int")
    want = brute_expired(manifest, expired)
    got = {(r.table_name, r.path): (r.length, r.held_by) for r in maintenance.expired_files(m, e).collect()}
    assert got == want and want
    snaps = m.select("table_name", "snapshot_id").distinct()
    for r in maintenance.expiry_summary(snaps, m, e).collect():
        mine = {p: n for (t, p), (n, _) in want.items() if t == r.table_name}
        touched = {p for t, s, p, _ in manifest if (t, s) in expired and t == r.table_name}
        assert (r.files_freed, r.bytes_freed, r.files_shared) == (len(mine), sum(mine.values()), len(touched - set(mine)))
    assert {r[0] for r in maintenance.live_files(m, e).collect()} == {p for t, s, p, _ in manifest if (t, s) not in expired}
    assert maintenance.expired_files(m, e.limit(0)).collect() == []


def test_expired_files_under_other_spellings_stay(spark):
    m = spark.createDataFrame([("t", 1, "file:/w/a%20b", 1), ("t", 2, "/w/a b", 1), ("t", 1, "/w/c", 1), (None, 1, "/w/d", 1)],
                              "table_name string, snapshot_id int, path string, length long")
    e = spark.createDataFrame([("t", 1), ("t", 1)], "table_name string, snapshot_id int")
    assert [(r.path, r.held_by) for r in maintenance.expired_files(m, e).collect()] == [("/w/c", 1)]


def test_upkeep_reports_expired_files_and_deletes_orphans(spark):
    path = small_table(spark, "nightly")
    old = names(path)
    inventory, snaps, manifest, out = (fresh_path(spark, n) for n in ("inventory", "snaps", "manifest", "nightly-out"))
    spark.createDataFrame([(p, OLD) for p in old] + [(f"{path}/k=p 1/_junk", OLD)], "path string, modified_at timestamp").write.parquet(inventory)
    spark.createDataFrame([("t", 1, OLD), ("t", 2, dt.datetime(2020, 2, 1))], "table_name string, snapshot_id long, committed_at timestamp").write.parquet(snaps)
    spark.createDataFrame([("t", 1, "/w/a", 5), ("t", 1, "/w/b", 6), ("t", 2, "/w/b", 6)],
                          "table_name string, snapshot_id long, path string, length long").write.parquet(manifest)
    open(f"{path}/k=p 1/_junk", "w").write("x")
    rows = content(spark, path)
    got = maintenance.main(["--table", path, "--partition-col", "k", "--snapshots", snaps, "--manifest", manifest,
                            "--inventory", inventory, "--delete-orphans", "--out", out])
    assert [r.path for r in got["expired_files"].collect()] == ["/w/a"]
    # the compacted files' predecessors are orphans of the inventory, but gone already
    deleted = {r.path: r.deleted for r in spark.read.parquet(f"{out}/deleted").collect()}
    assert {p for p, gone in deleted.items() if gone} == {f"{path}/k=p 1/_junk"} and set(deleted) == {*old, f"{path}/k=p 1/_junk"}
    assert content(spark, path) == rows
    with pytest.raises(SystemExit):
        maintenance.main(["--table", path, "--partition-col", "k", "--delete-orphans"])


# ---------------------------------------------------------------- one pass over the listings

def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("address, escapes, want", [
    ("//a/./b//c/", 0, "file:///a/b/c"), ("file:/a/%2Fb/", 0, "file:///a/%2Fb"), ("file:/a/%2Fb/", 1, "file:///a/b"),
    ("/a%252F.%252Fb", 3, "file:///a/b"), ("S3N://B//k/./", 0, "s3a://b/k"), ("x://b:///k", 0, "x://b:///k"),
    ("/a%c3%a9+%2B", 1, "file:///aé++"), ("", 0, "file:///"), ("/a/\n", 0, "file:///a\n")])
def test_steps_left_out_would_change_nothing(spark, address, escapes, want):
    assert spelt(spark, address, escapes=escapes) == want


def test_addresses_are_not_computed_again_by_a_filter(spark):
    files = spark.createDataFrame([(f"/w/a%20{i}", OLD) for i in range(9)], "path string, m timestamp")
    refs = spark.createDataFrame([(f"file:/w/a%20{i}",) for i in range(5)], "ref string")
    report = maintenance.orphan_files(files, refs, "path", "ref", "m")
    assert [line for line in optimized(report).split("\n") if "Filter" in line and "regexp_replace" in line] == []
    assert report.count() == 4


def test_missing_addresses_match_nothing(spark):
    files = spark.createDataFrame([("/w/a", OLD), (None, OLD)], "path string, m timestamp")
    refs = spark.createDataFrame([("/w/a",), (None,)], "ref string")
    assert [r.path for r in maintenance.orphan_files(files, refs, "path", "ref", "m").collect()] == [None]


def test_a_shared_folder_is_found_in_the_first_rows(spark):
    files = spark.range(9).select(F.concat(F.lit("/w/"), "id").alias("path"), F.lit(OLD).alias("m"))
    late = F.raise_error(F.lit("read to the end")).cast("string")
    refs = spark.range(0, 200, 1, 200).select(F.when(F.col("id") < 150, F.concat(F.lit("/w/"), "id")).otherwise(late).alias("ref"))
    maintenance.orphan_files(files, refs, "path", "ref", "m")
    # no folder of the first files is referenced, one of a later file is
    many = spark.range(0, 3000, 1, 3).select(F.concat(F.lit("/w/"), "id", F.lit("/f")).alias("path"), F.lit(OLD).alias("m"))
    assert maintenance.orphan_files(many, spark.createDataFrame([("/w/2999/f",)], "ref string"), "path", "ref", "m").count() == 2999


def listed_manifest(spark):
    path = fresh_path(spark, "manifest")
    spark.createDataFrame([("t", 1, "/w/a", 5), ("t", 1, "/w/b", 6), ("u", 2, "file:/w/b", 6), ("t", 1, None, 1), ("t", 2, None, 1)],
                          "table_name string, snapshot_id long, path string, length long").write.parquet(path)
    return path, spark.read.parquet(path), spark.createDataFrame([("t", 1)], "table_name string, snapshot_id long")


def test_expiry_summary_reads_the_manifest_once(spark):
    path, manifest, expired = listed_manifest(spark)
    snaps = spark.createDataFrame([("t", 1), ("t", 2), ("u", 2)], "table_name string, snapshot_id long")
    out = maintenance.expiry_summary(snaps, manifest, expired)
    assert optimized(out).count("Relation [") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("t", 2, 1, 2, 6, 1), ("u", 1, 0, 0, 0, 0)]


def test_expired_files_read_the_manifest_once(spark):
    path, manifest, expired = listed_manifest(spark)
    out = maintenance.expired_files(manifest, expired)
    assert optimized(out).count("Relation [") == 1
    assert sorted((str(r.path), r.length, r.held_by) for r in out.collect()) == [("/w/a", 5, 1), ("None", 1, 1)]
