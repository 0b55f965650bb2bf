"""The corpus pipeline: each stage's promises, and the whole against its parts."""

from __future__ import annotations

import array
import re

import corpus_pipeline as pipeline
import pytest
from claimloom.llm import credentials
from claimloom.llm.storage import shared_folder, stored

#: Names that stages use inside.
CLASHES = "of_id runs id band comp hub size row draw draws source_ range start turn_ a b node label decoded_ sha rep n signature of_row".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small)))
    return out


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    assert pipeline.ORACLE_SQL is None


def test_columns_and_kept_documents(steps):
    columns = steps[0].columns
    assert all(s.columns == columns for s in steps[1:-1])
    assert steps[1].count() >= 0.97 * steps[0].count()


def test_one_of_each_group_stays(steps):
    def shingles(text, k=5):
        w = text.encode().lower().split()
        return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    before = {r["doc_id"]: shingles(r["text"]) for r in steps[1].collect()}
    after = {r["doc_id"] for r in steps[2].collect()}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(after)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[:i] if near(before[a], before[b])]
    gone = set(before) - after
    assert all(any(near(before[g], s) for i, s in before.items() if i != g) for g in gone)


def test_secrets_are_gone_and_documents_stay(steps):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in steps[2:4])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = credentials.spans_of(r["text"])[1]
        assert after[i]["text"] == credentials.redacted(r["text"], spans)
        assert after[i]["n_chars"] == len(after[i]["text"])
        assert spans or after[i]["text"] == r["text"]


def test_mix_keeps_the_total(steps):
    words = lambda s: sum(len(WORD.findall(r["text"])) for r in s.collect())
    assert abs(words(steps[4]) - words(steps[3])) <= 20


def test_tokens_decode(steps):
    from tokenizers import Tokenizer
    from claimloom.llm.queries import tokenizer_path

    theirs = Tokenizer.from_file(tokenizer_path())
    rows = steps[5].collect()
    assert rows and all(r["round_trip"] for r in rows)
    texts = sorted((r["doc_id"], r["text"]) for r in steps[4].collect())
    got = sorted((r["doc_id"], theirs.decode(list(array.array("I", bytes(r["ids"]))), skip_special_tokens=False)) for r in rows)
    assert got == texts


def test_run_equals_its_stages(spark, small, steps):
    key = lambda s: sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in s.collect())
    assert key(pipeline.run(spark, small)) == key(steps[-1])


def test_odd_inputs(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "plain english words", "en", "s", 19, "e"), (3, "plain english words", "en", "s", 19, "e"), (4, "12345", "en", None, 5, None), (5, "more plain english text and words", "en", None, 1, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).selectExpr("*", *(f"'{x}' AS {x}" for x in CLASHES))
        for _, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, small))
        assert {r["doc_id"] for r in docs.collect()} <= ({3, 5} if data else set())
        assert bool(docs.count()) == bool(data)


def test_null_and_shared_ids_stay(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    story = "the old harbour was quiet that morning and the boats lay still while {} carried the bread from the house to the market"
    other = "every winter the teachers of this small school read long letters about the {} and the rivers of the north to their children"
    texts = [(None, story.format("Anna")), (None, other.format("mountains")), (7, "when the rain had stopped the two brothers walked slowly along the road to the station"), (7, "a good answer is short and clear and it does not leave the most important question open")]
    copies = [(None, texts[0][1]), (9, texts[1][1]), (7, texts[2][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts + copies], schema)
    kept = pipeline.drop_near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns
    rows = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()))
    # the copy with an id stays for the one without; equal rows without an id are one document
    assert rows == sorted([(0, texts[0][1]), (9, texts[1][1]), (7, texts[2][1]), (7, texts[3][1])])
    mixed = stored(pipeline.mix_sources(spark, stored(kept), small))
    assert mixed.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in mixed.collect()) == rows
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, small))
    assert docs.count() == len(rows)
    assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 7").count() == 2


def test_shared_folder_is_the_cluster_s(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = shared_folder(spark)
    assert folder == named.rstrip("/") if named else folder.startswith("file:")
