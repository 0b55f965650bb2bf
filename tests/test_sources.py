"""Files, specifications, stores and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from claimloom.operators.rules import RULES
from claimloom.sources import files, specs, stores
from claimloom.streaming import streams


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-2"), ("c.txt", b"no"), ("sub/d.png", b"x"), ("e.bmp", b"y")):
        (tmp_path / name).write_bytes(data)
    assert {r["filename"] for r in files.directory(spark, str(tmp_path)).collect()} == {"a.pdf", "b.PDF"}
    assert [r["path"].rsplit("/", 1)[-1] for r in files.survey_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF", "e.bmp", "d.png"]
    assert files.survey_files(spark, str(tmp_path), 2).count() == 2
    assert [r["arrival"] for r in files.bundle(files.directory(spark, str(tmp_path)), "c").orderBy("path").collect()] == [1, 2]


def test_content_store_is_idempotent(spark, tmp_path):
    frame = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    path = f"file://{tmp_path}/store"
    stores.put_content(frame, path)
    stores.put_content(frame, path)
    assert spark.read.parquet(path).count() == 2
    keys = spark.createDataFrame([("nope",)], "sha256 string")
    assert stores.get_content(spark, path, keys).first()["content"] is None
    assert stores.read_cache(spark, f"file://{tmp_path}/none", "a int").count() == 0


def test_specifications(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": list(RULES)}))
    assert len(specs.load_rules(str(tmp_path / "rules.json"))) == 12
    (tmp_path / "sources.json").write_text(json.dumps({"authorities": [{"id": "A", "name": "The Authority"}], "verification_sources": [{"id": "SRC_CERSAI", "authority": "A", "priority": 1, "tier_preliminary": "T1_OR_T2", "verifies": ["encumbrance", "existing_charges"], "keyed_by": ["cts_number"]}]}))
    source = specs.load_sources(spark, str(tmp_path / "sources.json")).first()
    assert (source["tier"], source["verifies"], source["freshness_days"], source["authority"]) == ("T2", ["property.encumbrance"], 30, "The Authority")
    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"case_id": "c", "documents": [{"file": "f", "document_type": "sale_deed", "fields": {"seller": "A"}, "absent_fields": ["owner"]}]}))
    (folder / "b.json").write_text("{ not json")
    fields, bad = specs.load_corpus(spark, str(folder))
    assert {(r["field"], r["absent"]) for r in fields.collect()} == {("seller", False), ("owner", True)}
    assert bad.count() == 1


def test_markdown_tables(spark):
    text = ["# One", "| # | Item |", "|---|---|", "| 1 | open thing |", "| ~~2~~ | done thing |", "## Two", "| 3 | other |"]
    got = specs.markdown_rows(spark.createDataFrame(list(enumerate(text)), "line_no int, line string")).orderBy("number").collect()
    assert [(r["section"], r["number"], r["closed"], r["text"]) for r in got] == [("One", 1, False, "open thing"), ("One", 2, True, "done thing"), ("Two", 3, False, "other")]


def test_search_and_reports(spark, tmp_path):
    frame = spark.createDataFrame([("d", 1, "the   Registrar\nof deeds"), ("d", 2, None)], "doc string, page int, text string")
    hit = stores.search(frame, r"registrar of", ("doc", "page")).first()
    assert (hit["at"], hit["hit"]) == (4, "Registrar of")
    stores.write_report(spark.createDataFrame([(1, 0.5)], "n int, r double"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 1
    assert "| a |" in stores.markdown("T", [{"a": 1}]) and "Nothing" in stores.markdown("T", [])


def test_stream_touches_only_new_cases(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 1)], "case_id string, n int").write.parquet(str(source))
    touched = []
    stream = spark.readStream.schema("case_id string, n int").parquet(str(source))
    run = lambda: streams.recompute_touched(stream, lambda cases, epoch: touched.append(sorted(r["case_id"] for r in cases.collect())), str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([("c2", 5)], "case_id string, n int").write.mode("append").parquet(str(source))
    run()
    assert [sorted(set(sum(touched[:-1], []))), touched[-1]] == [["c1", "c2"], ["c2"]]


def test_stream_tasks(spark, tmp_path):
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS opened_at UNION ALL SELECT 'z', timestamp'2024-03-01'").write.parquet(str(tmp_path / "tasks"))
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-03 00:00:00' AS seen_at UNION ALL SELECT 'z', timestamp'2024-06-01'").write.parquet(str(tmp_path / "seen"))
    tasks = streams.table_stream(spark, str(tmp_path / "tasks"), "k string, opened_at timestamp")
    seen = streams.table_stream(spark, str(tmp_path / "seen"), "k string, seen_at timestamp")
    got = streams.collected(streams.answered_tasks(tasks, seen, "k"), "tasks_test").where(F.col("state") == "ANSWERED").collect()
    assert [r["k"] for r in got] == ["a"]


def test_a_corrupt_cache_file_is_a_miss(spark, tmp_path):
    folder = tmp_path / "cache"
    spark.createDataFrame([("k", "page")], "key string, text string").write.parquet(f"file://{folder}")
    (folder / "broken.parquet").write_bytes(b"PAR1 this is no table")
    assert [r["key"] for r in stores.read_cache(spark, f"file://{folder}", "key string, text string").collect()] == ["k"]


def test_corpus_pages(spark):
    frame = spark.createDataFrame([("d", 1, "one  two"), ("d", 2, "x" * 1000), ("d", 3, None), ("e", 1, None)], "doc string, page int, text string")
    assert [(r["page"], r["n_pages"]) for r in stores.dumped(frame, 2).collect()] == [(2, 3)]
    got = {r["doc"]: (r["n_pages"], r["text_chars"], r["text_layer"], r["head"]) for r in stores.identified(frame).collect()}
    assert got == {"d": (3, 1008, True, "one two"), "e": (1, 0, False, "")}
