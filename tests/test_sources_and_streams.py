from __future__ import annotations

import gzip
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievework.session import shared_dir, work_path
from sievework.sources import csv, files, state
from sievework.streaming import ttl_cache, usage


def test_missing_words_are_read_as_null(spark, tmp_path):
    words = ["NA", "N/A", "null", "None", "nan", "", " ", "x"]
    path = tmp_path / "t.csv"
    path.write_text("id,word\n" + "".join(f'{i},"{w}"\n' for i, w in enumerate(words)))
    rows = csv.read_text_table(spark, str(path)).orderBy("id").collect()
    assert [r["word"] for r in rows] == [None] * 6 + [" ", "x"]


def test_quoted_cells_gzip_and_cap(spark, tmp_path):
    text = 'a,b\n"line one\nline two","say ""hi"""\n2,3\n4,5\n'
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(text.encode()))
    path = str(tmp_path / "t.csv.gz")
    df = csv.read_text_table(spark, path)
    assert df.count() == 3 and df.where("a = 'line one\nline two'").first()["b"] == 'say "hi"'
    capped = csv.read_capped(spark, path, 2)
    assert capped.truncated and capped.table.count() == 2
    assert not csv.read_capped(spark, path, 3).truncated
    (tmp_path / "u.csv").write_text("x\n1\n1\nNA\n")
    (tmp_path / "v.csv").write_text("x\n7\n")
    profiles = {r["file"].rsplit("/", 1)[-1]: r for r in csv.profile_folder(spark, str(tmp_path)).collect()}
    assert {f: p["n_rows"] for f, p in profiles.items()} == {"t.csv.gz": 3, "u.csv": 3, "v.csv": 1}
    assert (profiles["u.csv"]["duplicate_rows"], profiles["u.csv"]["missing_cells"]) == (1, 1)


def test_writers_skip_empty_quarantine(spark, tmp_path):
    df = spark.createDataFrame([("a ", None), ("", "b")], "x string, y string")
    clean, bad = csv.write_repair(df, df.limit(0), str(tmp_path), "t", "csv")
    assert bad is None and clean.endswith("t_clean")
    assert {tuple(r) for r in csv.read_text_table(spark, clean).collect()} == {("a ", None), (None, "b")}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    docs = tmp_path / "docs"
    (docs / "a.TXT").write_text("x" * 2001)
    (docs / "b.md").write_text("two words\nmore")
    (docs / "c.json").write_text('{"a":   [1, 2]}')
    (docs / "bad.json").write_text("{nope")
    (docs / "d.csv").write_text("h\n1\n")
    (docs / "latin.txt").write_bytes("café".encode("latin-1"))
    (docs / "blank.txt").write_text(" \n ")
    (docs / "e.exe").write_text("no")
    (docs / "f.pdf").write_text("not read")
    (docs / "node_modules" / "g.txt").write_text("skipped")
    return str(docs)


def test_files_are_found_read_and_ingested(spark, folder):
    found = files.find_files(spark, folder, with_content=True)
    read = {r["name"]: (r["text"], r["ok"]) for r in files.read_files(found).collect()}
    assert set(read) == {"a.TXT", "b.md", "c.json", "bad.json", "d.csv", "latin.txt", "blank.txt", "f.pdf"}
    assert read["latin.txt"] == ("café", True) and read["c.json"] == ('{"a":[1,2]}', True)
    assert read["bad.json"] == (None, False) and not read["blank.txt"][1] and not read["f.pdf"][1]
    counts = files.ingest_counts(files.read_files(found)).first()
    assert tuple(counts) == (8, 5, 3)
    passages = files.ingest_files(spark, folder)
    sources = {r["source"] for r in passages.collect()}
    assert {"a.TXT (chunk 1/2)", "a.TXT (chunk 2/2)", "b.md (chunk 1/1)"} <= sources and len(sources) == 6
    assert files.ingest_files(spark, folder, max_files=1).count() == 2
    assert [tuple(r) for r in files.chunks_per_source(files.ingest_folder(spark, folder)).collect()] == [("b.md", 1)]


def test_texts_are_written_by_all_tasks_into_small_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES_PER_FOLDER", 3)
    texts = [f"text {i}\nécole" for i in range(60)] + [None, "", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    folder = files.write_texts(rows, "text", str(tmp_path / "texts"))
    written = [p for p in (tmp_path / "texts").rglob("*") if p.is_file()]
    assert sorted(p.read_text() for p in written) == sorted((t or "") + "\n" for t in texts)
    assert len({p.name for p in written}) == len(texts) and len({p.name.split("-")[0] for p in written}) > 1
    assert max(len(list(p.iterdir())) for p in (tmp_path / "texts").iterdir()) <= 3
    assert files.find_files(spark, folder).count() == len(texts)


@pytest.fixture
def odd_names(tmp_path):
    """Names and kinds of entries that Spark's reader leaves out, next to some that it takes."""
    for below in ("sub/deep", "_hidden", ".dot", "k=v", "_x=y"):
        (tmp_path / "odd" / below).mkdir(parents=True)
    names = ["a.txt", "_metadata.txt", "_m.txt", ".h.txt", "_a=b.txt", "sp ace %41.txt", "br[1].txt", "é.txt", "y.md", "A.TXT",
             "x._COPYING_", "sub/b.txt", "sub/deep/c.txt", "_hidden/d.txt", ".dot/e.txt", "k=v/f.txt", "_x=y/g.txt", "line\n.txt"]
    for name in names:
        (tmp_path / "odd" / name).write_text(f"words of {name}")
    (tmp_path / "odd" / "empty.txt").touch()
    (tmp_path / "odd" / "link.txt").symlink_to(tmp_path / "odd" / "a.txt")
    (tmp_path / "odd" / "linked").symlink_to(tmp_path / "odd" / "sub")
    (tmp_path / "odd" / "nowhere.txt").symlink_to(tmp_path / "none")
    return str(tmp_path / "odd")


def test_files_are_listed_and_read_by_tasks(spark, odd_names, monkeypatch):
    monkeypatch.setattr(files, "LISTED_ROWS", 2)
    monkeypatch.setattr(files, "READ_BYTES", 30)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(odd_names)
    expected = sorted((r["path"], r["length"], bytes(r["content"])) for r in read.collect() if r["path"].lower().endswith((".txt", ".md")))
    for folder in (odd_names, f"file://{odd_names}/"):
        found, listed = files.find_files(spark, folder, with_content=True), files.find_files(spark, folder)
        assert sorted((r["path"], r["length"], bytes(r["content"])) for r in found.collect()) == expected and len(expected) > 8
        assert [tuple(r) for r in listed.collect()] == [e[:2] for e in expected]
        assert not any(".txt" in name for df in (found, listed) for name in df.inputFiles())  # the driver knows of no single file
    assert [tuple(r)[:2] for r in files.find_files(spark, f"{odd_names}/a.txt").collect()] == [(f"file:{odd_names}/a.txt", 14)]
    assert files.find_files(spark, f"{odd_names}/sub", recursive=False).count() == 1
    with pytest.raises(AnalysisException):
        files.find_files(spark, f"{odd_names}/absent")


def test_a_task_that_runs_again_writes_the_same_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"text {i}",) for i in range(40)], "text string").coalesce(1)
    folder = str(tmp_path / "texts")
    for _ in range(2):
        files.write_texts(rows, "text", folder)
    assert sorted(p.read_text() for p in (tmp_path / "texts").rglob("*.txt")) == sorted(f"text {i}\n" for i in range(40))
    assert not list((tmp_path / "texts").glob(".*"))


def test_a_folder_is_ingested_by_tasks(spark, odd_names):
    for pattern in ("*.txt", "[ab_]*.{txt,md}", "?.*", "br\\[1\\].txt"):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(odd_names)
        passages = files.ingest_folder(spark, odd_names, pattern)
        assert sorted(r["source"] for r in passages.collect()) == sorted(r["path"].rsplit("/", 1)[1] for r in read.collect())
        assert not any(".txt" in name for name in passages.inputFiles())


def test_a_bad_byte_does_not_fail_a_folder(spark, tmp_path):
    (tmp_path / "good.md").write_text("good words")
    (tmp_path / "bad.md").write_bytes(b"some \xff\xfe bytes \xe9")
    found = {r["source"]: r["text"] for r in files.ingest_folder(spark, str(tmp_path)).collect()}
    assert found == {"good.md": "good words", "bad.md": "some bytes"}


def test_appending_twice_adds_nothing(spark, folder):
    store = work_path(spark, "store")
    assert files.read_passages(spark, store).isEmpty()
    for _ in range(2):
        files.append_passages(files.ingest_files(spark, folder), store)
    assert files.read_passages(spark, store).count() == 6
    assert files.list_passages(files.read_passages(spark, store), 4).count() == 4


def test_state_may_be_absent_or_broken(spark, tmp_path):
    schema = "total bigint"
    assert state.read_or_empty(spark, str(tmp_path / "none"), schema).isEmpty()
    (tmp_path / "broken.json").write_text("{nope")
    assert state.read_or_empty(spark, str(tmp_path / "broken.json"), schema).isEmpty()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def outcomes(requests, ttl):
    """Hits and misses by going through the requests one by one."""
    opened, found = {}, {}
    for event, key, at in sorted(requests, key=lambda r: (r[2], r[0])):
        found[event] = key not in opened or at - opened[key] > ttl * 1_000_000
        if found[event]:
            opened[key] = at
    return found


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("segment_rows", [200_000, 4])
def test_cache_outcomes_match_one_by_one(spark, seed, segment_rows):
    rng = random.Random(seed)
    ttl = 60
    requests = [(i, rng.choice(["hot", "hot", "hot", "cold"]), rng.randint(0, rng.choice([500, 40_000])) * 250_000)
                for i in range(300)]
    df = spark.createDataFrame(requests, "event_id bigint, request_key string, micros bigint")
    found = {r["event_id"]: r["is_miss"] for r in ttl_cache.classify(df, ttl, segment_rows).collect()}
    assert found == outcomes(requests, ttl)


def test_cache_stream_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    requests = sorted(((i, rng.choice("ab"), rng.randint(0, 20_000) * 1_000_000) for i in range(200)), key=lambda r: r[2])
    requests = [(i, k, t) for i, (_, k, t) in enumerate(requests)]
    schema = "event_id bigint, request_key string, ts timestamp"
    for part in range(4):
        rows = spark.createDataFrame(requests[part * 50:part * 50 + 50], "event_id bigint, request_key string, micros bigint")
        rows.select("event_id", "request_key", F.timestamp_micros("micros").alias("ts")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (ttl_cache.classify_stream(stream, 3600, "10 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
     .awaitTermination())
    found = {r["event_id"]: r["is_miss"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == outcomes(requests, 3600)


def test_running_totals_over_several_batches(spark, tmp_path):
    schema = "model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint"
    for i in range(3):
        spark.createDataFrame([("a", i, 1, 0, 0), (f"m{i}", 5, 5, 1, 1)], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    usage.running_totals(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    found = {r["model"]: (r["calls"], r["input_tokens"]) for r in usage.current_totals(spark, str(tmp_path / "out")).collect()}
    assert found == {"a": (3, 3), "m0": (1, 5), "m1": (1, 5), "m2": (1, 5)}
