"""The ten operators against brute force, and on empty, null, repeated and very long inputs."""

from __future__ import annotations

import array
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, credentials, kdshards, langid, minhash, mixing, quotes, substrings, syncmers, topk
from claimloom.llm.graph import components
from claimloom.llm.queries import ORACLE, QUERIES, tokenizer_path
from claimloom.llm.words import Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def documents(table):
    return {r["doc_id"]: r for r in table.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a very long text, words beyond ASCII, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    base = [f"t{i}" for i in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    texts = [None, "", "   \n\t", "one", "one", "Été naïve Éclair " * 5, long, " ".join(base), " ".join(near), " ".join(base), "a" * 5000, "two words", "Two  WORDS", "token = abcdefghijkl0123"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", i) for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", None, None, None)]
    frame = spark.createDataFrame(rows, DOC)
    clash = {c: F.lit(1) for c in ("id", "n", "ids", "size", "hub", "band", "label", "score", "place", "turn", "part", "draws", "shard", "key")}
    return frame.withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(texts, k, percent=80):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


# -- words and graph ---------------------------------------------------------------------------


def test_words_are_those_of_the_pattern(spark):
    import pyarrow as pa

    texts = ["a b", None, "", " x\ty\x0bz\x1cq ", "é ü", "end", "b a"]
    column = pa.array(texts)
    words = Words(column)
    got = [[bytes(words.data[s:e]).decode() for s, e, d in zip(words.start, words.end, words.doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    hashes = words.hashes()
    by = defaultdict(set)
    for s, e, h in zip(words.start, words.end, hashes, strict=True):
        by[bytes(words.data[s:e])].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), column], ["id", "text"])
    assert sum(b.num_rows for b in slices(batch, "text")) == 7


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_components(table, documents, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table, k=k).collect()}
    assert got == brute_components({i: r["text"] for i, r in documents.items()}, k)


def test_minhash_on_near_copies(spark):
    """A group whose members differ from a base in other places: links are many and close to the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for j in rng.choice(120, rng.integers(2, 14), replace=False):
            words[j] = f"x{rng.integers(1_000_000)}"
        texts[i] = " ".join(words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect()}
    assert got == brute_components(texts, 2)


def test_minhash_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    test_minhash_on_near_copies(spark)


def test_bands_that_agree_in_low_bits_only_did_not_meet():
    """Rows whose earlier band has equal 16-bit minima but another bucket meet in the bucket that they do share."""
    import pyarrow as pa

    signature = np.arange(minhash.MINIMA, dtype="<u2").tobytes()
    keys = [[100 + i, *range(1, minhash.BANDS)] for i in range(2)]
    group = lambda place: pa.table({"chunk": [0, 0], "place": [place] * 2, "n": [9] * 2, "signature": [signature] * 2, "bands": pa.array(keys, pa.list_(pa.int64()))})
    met = lambda place: [(i, later.tolist()) for i, later in minhash._candidates(group(place), minhash.least_matches(0.8, 1e-5), np.array([0, 1]), 80)]
    assert met(1) == [(0, [1])]
    assert met(2) == []  # they shared bucket 1


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_words_and_texts_that_collide_modulo_powers_of_two_stay_apart(spark):
    """Thue-Morse sequences and their complements have equal polynomial hashes modulo 2^64, whatever the base."""
    words = ["".join(thue_morse(2048, *x)) for x in ("ab", "ba")]
    sequences = [" ".join(thue_morse(2048, *x)) for x in (("aa", "bb"), ("bb", "aa"))]
    frame = spark.createDataFrame(list(enumerate(words + sequences)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, k=2).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}  # the two sequences have the same three pairs of words
    filler = " ".join(f"w{i}" for i in range(49))
    frame = spark.createDataFrame([(0, f"{filler} {words[0]}"), (1, f"{filler} {words[1]}"), (2, sequences[0][: 3 * 64]), (3, sequences[1][: 3 * 64])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame).collect()}
    assert got == brute_removed({r["doc_id"]: r["text"] for r in frame.collect()}, 50)
    assert got[1][1] == 0


def test_hot_buckets_and_classes(spark, monkeypatch):
    """The same components when every bucket and class of more than two rows is hot, and chunks are tiny."""
    from claimloom.llm import storage

    monkeypatch.setattr(storage, "HOT_ROWS", 2)
    monkeypatch.setattr(minhash, "HOT_ROWS", 2)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", 300)
    test_minhash_on_near_copies(spark)
    texts = {i: "one text that many rows repeat" if i % 3 else f"own text number {i} of {i}" for i in range(30)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect()}
    assert got == brute_components(texts, 2)


def test_posterior_bounds_are_safe():
    fewest = minhash.least_matches(0.8, 1e-5)
    assert fewest == tuple(sorted(fewest)) and all(f < 0.8 * 32 * (i + 1) for i, f in enumerate(fewest))
    assert all(a <= b for a, b in zip(minhash.least_matches(0.8, 1e-9), fewest, strict=True))


def test_minhash_odd(odd, empty):
    rows = minhash.near_duplicates(odd, k=2).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count()
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert [got[i]["component_id"] for i in (0, 1, 2, 3, 4, 11, 12)] == [0, 1, 2, 3, 3, 11, 11]
    assert {got[i]["component_id"] for i in (7, 8, 9)} == {7}
    assert minhash.near_duplicates(empty).count() == 0


# -- 2 -------------------------------------------------------------------------------------------


def brute_top(rows, k=5):
    vectors = {}
    sound = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in sound:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in sound if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out, vectors


def test_top_k(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op2_exact_top_k"](spark, small).collect()}
    assert got == brute_top([(r["vec_id"], r["embedding"]) for r in frame.collect()])[0]


def test_top_k_stops_on_proof_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.1, 8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(30)] + [(50 * 9, None), (50 * 10, []), (50 * 11, [float("nan")] * 8), (50 * 12, [None] * 8), (7777, [float("inf")] * 8), (50 * 13, [0.25] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top(rows)[0]
    twice = topk.top_k(frame.where("vec_id < 200").unionByName(frame.where("vec_id = 50")), F.col("vec_id") % 50 == 0).where("query_id = 50").collect()
    once = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame.where("vec_id < 200"), F.col("vec_id") % 50 == 0).where("query_id = 50").collect()]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in twice) == sorted(once * 2)  # each of the two rows has its own
    few = frame.where("vec_id < 3")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk.top_k(frame.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("size", [2.0**25, 2.0**30, 1e300])
def test_top_k_of_large_numbers(spark, size):
    """Exact beyond 53 bits; scores beyond a long rank exactly and are given as the nearest long."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-1000, 1000, 3) / 8 * size / 1000 + rng.integers(-9, 9, 3)).tolist()) for i in range(60)]
    exact = lambda x: int(x) * 256 if abs(x) > 2**52 else int(np.floor(x * 256))
    vectors = [(i, [exact(x) for x in v]) for i, v in rows]
    want = []
    for i, v in vectors:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vectors if j != i)[:5]
            want += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -x))) for n, (x, j) in enumerate(scored)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_stops_early():
    """Vectors near their queries are proved best before all postings are read."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 6, (4000, 16)).astype(float)
    vectors[:8] = 200
    found = topk.Index(vectors).search(np.full((1, 16), 100.0), np.ones((1, 4000), bool), 5)[0]
    assert set(range(8)) <= set(found.tolist()) and len(found) <= 80


# -- 3 -------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, small, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    theirs = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe_round_trip"](spark, small).collect()}
    for i, r in documents.items():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_hard_texts():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), "rb") as f:
        mine = bpe.Coder(f.read())
    theirs = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "\n\n \t x", "a<|endoftext|>b<|endoftext|>", "it's THEY'LL we'd", "a" * 3000, "ab" * 4000, "日本語テキスト 한국어 😀👩‍👩‍👧", "\x00\x1c\x85 　x", "the" * 900 + "\n" * 700, " " * 900, "é" * 400, "1234567890" * 90, "!?" * 500]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert array.array("I", mine.encode(t)).tolist() == ids
        assert mine.decode(mine.encode(t)) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_odd(odd, empty):
    rows = {r["doc_id"]: r for r in bpe.round_trip(odd, tokenizer_path()).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0
    assert rows[6]["decoded_sha256"] == hashlib.sha256(" ".join(f"w{i % 977}" for i in range(30_000)).encode()).hexdigest()
    assert bpe.round_trip(empty, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd, tokenizer_path())  # it has a column ids already
    named = bpe.decode(bpe.encode(odd, tokenizer_path(), ids_col="my_ids"), tokenizer_path(), ids_col="my_ids")
    assert named.where("coalesce(text, '') <> decoded").count() == 0


# -- 4 -------------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there world\nsecond line"),
        (1, 1, "assistant", "Ada wrote:\n> hello  there WORLD\n\nI agree."),
        (1, 2, "user", "> > Hello there world\n> I agree.\nGood"),
        (1, 3, "user", ">unknown\nfine"),
        (2, 0, "user", None),
        (2, 1, "user", ""),
        (2, 2, None, "> Hello there world"),
        (None, 0, "user", "x"),
        (3, 0, "user", "> later\n"),
        (3, 1, "user", "later"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(0), "thread": F.lit(0), "hash": F.lit(0)})
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(rows)
    assert [(got[1, t]["thread"], got[1, t]["depth"], got[1, t]["reply_to"], got[1, t]["text"]) for t in range(4)] == [
        (0, 0, None, "Hello there world\nsecond line"),
        (0, 1, 0, "I agree."),
        (0, 2, 1, "Good"),
        (3, 0, None, "fine"),
    ]
    assert (got[2, 0]["text"], got[2, 1]["text"]) == (None, "")
    assert got[2, 2]["reply_to"] is None and got[2, 2]["text"] == ""  # said in another conversation only
    assert got[3, 0]["reply_to"] is None  # not yet said
    ordered = quotes.reply_ordered(quotes.link_quotes(frame)).where("conv_id = 1").collect()
    assert [r["turn"] for r in ordered] == [0, 1, 2, 3]
    assert quotes.link_quotes(frame.where("conv_id = 99")).count() == 0


def brute_replies(rows):
    """(conv, turn) -> (reply_to, thread, depth, n_linked) by looking through all that was said before."""
    said = {(c, t): {h for level, h, _ in quotes.passages(quotes.levels(x or "")) if not level} for c, t, x in rows}
    out = {}
    for c, t, text in sorted(rows, key=lambda r: r[:2]):
        weights, linked = defaultdict(int), 0
        for level, h, letters in quotes.passages(quotes.levels(text or "")):
            sources = [s for k, s in said if k == c and s < t and h in said[k, s]]
            if level and sources:
                weights[level, max(sources)] += letters
                linked += 1
        best = min(weights, key=lambda w: (w[0], -weights[w], -w[1]))[1] if weights else None
        _, thread, depth, _ = out[c, best] if weights else (None, t, -1, 0)
        out[c, t] = (best, thread, depth + 1, linked)
    return out


@pytest.mark.parametrize("span", [3, 4096])
def test_quotes_against_every_earlier_message(spark, monkeypatch, span):
    """Random conversations of few lines, so that passages are said and quoted often, nested, cut and mixed."""
    monkeypatch.setattr(quotes, "SPAN", span)
    rng = np.random.default_rng(8)
    lines = ["Yes.", "No.", "The harbour was quiet that morning", "the boats  lay STILL", "Shall we meet at noon?", "a", "We carried the bread home", ""]
    rows = []
    for conv in range(6):
        for turn in range(30):
            own = [lines[i] for i in rng.integers(0, len(lines), rng.integers(1, 4))]
            quoted = []
            for level in (1, 2):
                earlier = [r for r in rows if r[0] == conv]
                if earlier and rng.random() < 0.6:
                    source = earlier[rng.integers(len(earlier))][2].split("\n")
                    quoted += ["> " * level + x for x in source[: rng.integers(1, 5)] if not x.startswith(">")] + ["> " * level + "Yes."] * int(rng.integers(0, 2))
            rows.append((conv, turn, "\n".join([*quoted, "", *own])))
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["n_linked"]) for r in quotes.link_quotes(frame).collect()}
    want = brute_replies(rows)
    assert got == want and sum(w[0] is not None for w in want.values()) > 60


def test_a_paragraph_weighs_more_than_a_yes(spark):
    rows = [(1, 0, "user", "Shall we carry the bread from the house to the market?\nYes."), (1, 1, "user", "Yes."), (1, 2, "user", "> Shall we carry the bread from the house to the market?\n\n> Yes.\nFine")]
    got = {r["turn"]: r["reply_to"] for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0}


def test_quote_levels():
    text = "On Monday Bo wrote:\n>> deep\n> shallow\n> still\n\nown"
    lines = quotes.levels(text)
    assert [n for n, _ in lines] == [2, 2, 1, 1, 0, 0]
    assert quotes.unquoted(lines) == "own"
    assert quotes.unquoted(quotes.levels("a\n\n\n\nb")) == "a\n\n\n\nb"


def test_conversations_without_quotes_stay(spark, small):
    got = {(r["conv_id"], r["turn"]): r["text"] for r in QUERIES["op4_chat_formatting"](spark, small).collect()}
    want = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    assert got == {k: quotes.unquoted(quotes.levels(t)) for k, t in want.items()}


# -- 5 -------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_language_id"](spark, folder).collect()
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]]["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02


def test_language_never_reads_held_out_rows(spark):
    rows = [(i, "completely ordinary english words here " * 3 if i % 2 else "ganz andere deutsche worte stehen hier " * 3, "en" if i % 2 else "de", "s", 0) for i in range(60)]
    frame = spark.createDataFrame(rows, DOC)
    spoilt = frame.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert set(langid.learn(spoilt)) == {"en", "de"}
    assert {r["lang_pred"] for r in langid.identify(frame).collect()} == {"en", "de"}


def test_learned_rows_are_bounded_and_whole(spark, monkeypatch):
    """Rows without an id, equal ids, equal texts and many languages: at most SAMPLE different texts of LANGUAGES languages, each whole."""
    monkeypatch.setattr(langid, "SAMPLE", 5)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    long = "word after word " * 1000
    rows = [(None if i % 2 else 2, f"{long}{i % 40}", f"l{i % 2 if i < 300 else i}", "s", 0) for i in range(320)]
    learned = langid.learn(spark.createDataFrame(rows, DOC))
    assert len(learned) == 3 and list(learned)[:2] in (["l0", "l1"], ["l1", "l0"])
    for text in learned.values():
        lines = text.decode().split("\n")
        assert len(lines) == len(set(lines)) <= 5 and all(x.startswith(long) for x in lines)
    assert len(learned["l1"].decode().split("\n")) == 5


def test_language_odd(odd, empty, spark):
    rows = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (0, 1, 2)] == [("und", 0.0)] * 3
    assert rows[3]["lang_pred"] == "en"  # the only one that is learned
    assert langid.identify(empty).count() == 0
    assert langid.keep_identified(odd, langid.learn(odd)).columns == odd.columns


# -- 6 -------------------------------------------------------------------------------------------


def brute_removed(texts, length):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(words):
        for p in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][p : p + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 10, 7, 2])
def test_substrings(table, documents, length):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(table, length=length).collect()}
    assert got == brute_removed({i: r["text"] for i, r in documents.items()}, length)


def test_substrings_overlap_and_repeat_inside(spark):
    rng = np.random.default_rng(2)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(3)]
    texts = {}
    for i in range(40):
        words = [f"u{rng.integers(10_000_000)}" for _ in range(30)] + passages[i % 3][rng.integers(0, 8) :] + ["same"] * int(rng.integers(0, 130)) + passages[(i + 1) % 3][: rng.integers(45, 60)]
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame, length=50).collect()}
    assert got == brute_removed(texts, 50)


def test_repeats_double_until_none_survives(spark):
    rng = np.random.default_rng(9)
    run = [f"r{i}" for i in range(137)]
    texts = {i: " ".join([f"u{rng.integers(10_000_000)}" for _ in range(20)] + run[: 137 - 40 * i] + [f"v{rng.integers(10_000_000)}" for _ in range(5)]) for i in range(3)}
    words = {i: t.split() for i, t in texts.items()}
    want, length = {}, 10
    while True:
        holders = defaultdict(set)
        for i, w in words.items():
            for p in range(len(w) - length + 1):
                holders[tuple(w[p : p + length])].add(i)
        here = {(i, p): length for i, w in words.items() for p in range(len(w) - length + 1) if len(holders[tuple(w[p : p + length])]) > 1}
        if not here:
            break
        want |= here
        length *= 2
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["place"]): r["words"] for r in substrings.repeat_levels(frame, length=10).collect()}
    assert got == want and max(got.values()) == 80


def test_substrings_odd(odd, empty, spark):
    rows = substrings.remove_repeats(odd, length=50).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    texts = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None}
    want = brute_removed(texts, 50)
    assert all((got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == w for i, w in want.items())
    assert substrings.remove_repeats(empty).count() == 0
    shared = " ".join(f"z{i}" for i in range(80))
    twice = spark.createDataFrame([(1, "a " + shared), (2, shared + " b"), (2, "other " * 60)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(twice).collect()) == [(1, 0), (2, 0), (2, 80)]


# -- 7 -------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    out = {s: total * weight[s] / sum(weight.values()) for s in names}
    while over := [s for s in names if s not in full and out[s] > cap * sizes[s]]:
        spare = sum(out[s] - cap * sizes[s] for s in over)
        full |= set(over)
        out |= {s: float(cap * sizes[s]) for s in over}
        rest = [s for s in names if s not in full]
        out |= {s: out[s] + spare * weight[s] / sum(weight[x] for x in rest) for s in rest}
    return out


def check_mix(rows, texts):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for t in texts)


def test_mixing(table, documents):
    rows = mixing.mix(table).collect()
    check_mix(rows, [r["text"] for r in documents.values()])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(table.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    where = defaultdict(set)
    for r in rows:
        assert [d["epoch"] for d in r["draws"]] == sorted({d["epoch"] for d in r["draws"]})  # once an epoch
        assert sum(d["words"] for d in r["draws"]) == r["taken"]
        assert all(0 < d["words"] <= r["size"] and 0 <= d["shard"] < mixing.SHARDS for d in r["draws"])
        for d in r["draws"]:
            where[r["source"], d["block"]].add(d["shard"])
    assert all(len(x) == 1 for x in where.values())  # a block is drawn into one shard
    assert {s for x in where.values() for s in x} == set(range(mixing.SHARDS))


def test_mixing_by_hand(spark, table):
    """Size, source size and target against SQL; places, blocks, shards and words against a walk along each stream."""
    import duckdb

    rows = mixing.mix(table).collect()
    sources = spark.createDataFrame([(p, -(-round(t) // mixing.BLOCK)) for p, t in enumerate(brute_targets(_sizes(rows)).values())], "place int, blocks long")
    names = list(brute_targets(_sizes(rows)))
    ends = {names[r["place"]]: r["ends"] for r in mixing.shard_quotas(sources, mixing.SHARDS, mixing.SEED).collect()}
    keyed = table.select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("turn")).collect()
    turns = {r["doc_id"]: r["turn"] % 2**64 for r in keyed}
    asked = [(i, b, e[-1]) for i, e in enumerate(ends[n] for n in names) for b in range(e[-1])]
    rank = spark.createDataFrame(asked, "place int, b long, blocks long").select("place", "b", F.expr(mixing.permuted("b", "blocks", mixing.SEED)).alias("r")).collect()
    rank = {(names[r["place"]], r["b"]): r["r"] for r in rank}
    for name in names:
        own = sorted((r for r in rows if r["source"] == name), key=lambda r: turns[r["doc_id"]])
        quota, at, want = round(own[0]["target"]), 0, defaultdict(list)
        for epoch in range(3):
            for r in own:
                if r["size"] and at < quota:
                    block = at // mixing.BLOCK
                    shard = sum(x <= rank[name, block] for x in ends[name])
                    want[r["doc_id"]].append((epoch, block, shard, min(r["size"], quota - at)))
                at += r["size"]
        assert all([(d["epoch"], d["block"], d["shard"], d["words"]) for d in r["draws"]] == want[r["doc_id"]] for r in own)
    frame = [(r["doc_id"], r["source"], r["size"]) for r in rows]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (doc_id BIGINT, source VARCHAR)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", [f[:2] for f in frame])
    texts = table.select("doc_id", "text").toPandas()  # noqa: F841
    sql = r"""
        WITH d AS (SELECT t.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM t JOIN texts USING (doc_id)),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
        r AS (SELECT *, 3 * source_size / weight AS ratio FROM s),
        levels AS (SELECT a.ratio, ((SELECT sum(source_size) FROM r) - 3 * coalesce((SELECT sum(source_size) FROM r b WHERE b.ratio < a.ratio), 0)) / ((SELECT sum(weight) FROM r) - coalesce((SELECT sum(weight) FROM r b WHERE b.ratio < a.ratio), 0)) AS level FROM r a),
        it AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio LIMIT 1)
        SELECT doc_id, size, source_size, least(3 * source_size, weight * level) FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, it"""
    want = {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
    assert len(want) == len(rows)
    for r in rows:
        assert (r["size"], r["source_size"]) == want[r["doc_id"]][:2] and r["target"] == pytest.approx(want[r["doc_id"]][2], abs=1e-6)


def _sizes(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    return sizes


def test_mix_comes_from_the_tree(table, monkeypatch):
    """Without the tree's quotas nothing is taken: shards that draw no blocks give no words."""
    real = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda sources, shards, seed: real(sources, shards, seed).withColumn("ends", F.transform("ends", lambda _: F.lit(0).cast("long"))))
    assert mixing.mix(table).agg(F.sum("taken")).first()[0] == 0


def test_materialised_shards_are_shuffled(spark, table):
    mixed = mixing.mix(table)
    made = mixing.materialised(table).withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()).select("doc_id", "text", "line").orderBy("line").collect()
    keys = sorted((d["shard"], d["sort_key"], r["doc_id"], d["words"]) for r in mixed.collect() for d in r["draws"])
    assert [(r["doc_id"], len(WORD.findall(r["text"]))) for r in made] == [k[2:] for k in keys]


@pytest.mark.parametrize("blocks", [1, 2, 7, 1000])
def test_blocks_are_permuted(spark, blocks):
    got = [r[0] for r in spark.range(blocks).select(F.expr("3 as place"), F.col("id").alias("b")).select(F.expr(mixing.permuted("b", f"{blocks}L", 5))).collect()]
    assert sorted(got) == list(range(blocks)) and (blocks < 10 or got != sorted(got))


def test_sixteen_thousand_million_blocks(spark):
    """Quotas stay exact, draws follow the hypergeometric spread, and permuted places stay in bounds."""
    n = [8_000_000_000, 7_999_999_000, 1_000]
    got = {r["place"]: r["ends"] for r in mixing.shard_quotas(spark.createDataFrame(list(enumerate(n)), "place int, blocks long"), 4, 5).collect()}
    assert [got[i][-1] for i in range(3)] == n and all(e == sorted(e) for e in got.values())
    left = got[0][1]
    assert 0 < abs(left - 4_000_000_000) < 6 * 31_623
    places = spark.range(1000).select(F.expr("0 as place"), (F.col("id") * 15_999_983).alias("b")).select(F.expr(mixing.permuted("b", "16000000000L", 5)).alias("r")).agg(F.min("r"), F.max("r"), F.countDistinct("r")).first()
    assert 0 <= places[0] and 8_000_000_000 < places[1] < 16_000_000_000 and places[2] == 1000


def test_mixing_caps_and_hot_sources(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("b", 5000), ("a", 10), ("a", 5), (None, 40), ("c", 0), ("é", 3000), ("z", 700)] * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix(frame, block=64).collect(), [r[1] for r in rows])


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    check_mix(rows, [r["text"] for r in odd.select("text").collect()])
    assert mixing.mix(empty).count() == 0
    assert mixing.materialised(odd).columns == odd.columns
    assert mixing.materialised(odd).agg(F.count("*")).first()[0] == sum(len(r["draws"]) for r in rows)


def test_materialised_words(table):
    mixed = mixing.mix(table)
    made = mixing.materialised(table)
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    got = defaultdict(int)
    for r in made.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert dict(got) == {k: v for k, v in taken.items() if v}


def test_hypergeometric_quotas_are_exact(spark):
    sources = spark.createDataFrame([(0, 100_000), (1, 3), (2, 0), (3, 77), (4, 9_000_000)], "place int, blocks long")
    got = {r["place"]: r["ends"] for r in mixing.shard_quotas(sources, 12, 5).collect()}
    assert {p: e[-1] for p, e in got.items()} == {0: 100_000, 1: 3, 2: 0, 3: 77, 4: 9_000_000}
    assert all(e == sorted(e) and len(e) == 12 for e in got.values())
    sums = [sum(e[i] - (e[i - 1] if i else 0) for e in got.values()) for i in range(12)]
    assert max(sums) - min(sums) <= 4
    spread = np.diff([0, *got[0]])
    assert abs(spread - 100_000 / 12).max() < 6 * (100_000 / 12) ** 0.5


# -- 8 -------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secrets(spark, small, documents):
    for r in QUERIES["op8_secret_scan"](spark, small).collect():
        base = brute_spans(documents[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    "text",
    ["token: api_key: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "xAKIAAKIA" + "A1" * 9, "AKIA AKIA" + "B" * 13, "deadbeef" * 4 + "g" + "a" * 15, "PassWord\"= 'Abcdefghijkl'", "ſecret=abcdefghijklmnop", "APIKEY:aaaaaaaaaaaa,api_key=bbbbbbbbbbb", "é token = " + "0" * 20],
)
def test_base_spans(text):
    assert credentials._written(credentials.base_spans(text)) == brute_spans(text)


def test_weak_parts_need_complements():
    kinds = lambda text: [k for _, _, k in credentials.spans_of(text)[1]]
    assert kinds("host=db.internal.example:5432") == []
    assert kinds("user = alice") == []
    assert kinds("user = alice\npassword = hunter22") == ["identifier", "secret"]
    assert kinds("user = alice\npassword = hunter22\nhost = db.internal:5432") == ["identifier", "secret", "endpoint"]
    assert kinds("user = alice\n\npassword = hunter22") == []  # another scope
    assert kinds("user = alice" + " x" * 300 + " password = hunter22") == ["identifier", "secret"]  # however far apart in a scope
    assert kinds("AKIA" + "A" * 16 + " Zx9" + "aB3" * 9) == ["access", "secret"]
    assert credentials.redacted("a token = " + "f" * 20 + " b", credentials.spans_of("a token = " + "f" * 20 + " b")[1]) == "a <assign> b"
    assert credentials.spans_of(None) == ([], [])


def test_parts_inside_one_url():
    text = "see https://api.example.com/x?user=bob&token=abc12345 now"
    spans = credentials.spans_of(text)[1]
    assert [(k, text[s:e]) for s, e, k in spans] == [("endpoint", text[4:53]), ("identifier", "user=bob"), ("secret", "token=abc12345")]
    assert credentials.redacted(text, spans) == "see <endpoint> now"
    kinds = lambda text: [k for _, _, k in credentials.spans_of(text)[1]]
    assert kinds("see https://api.example.com/x?user=bob now") == kinds("see https://api.example.com/x?token=abc12345 now") == []
    assert kinds("user=bob+token=abc12345") == ["identifier", "secret"]  # matches that overlap, values that do not
    assert kinds("https://a.example/x?user=Zx9aB3Zx9aB3Zx9aB3Zx9") == []  # one value in two roles proves nothing
    assert kinds("https://a.example/x?user=bob&token=abcdefghijkl0123") == ["endpoint", "identifier", "assign"]
    assert kinds("AKIA" + "A" * 16 + " https://a.example/x") == ["access"]


def test_linking_equals_every_pair():
    """Random texts of parts against all pairs: paragraph, and values apart."""
    rng = np.random.default_rng(5)
    bits = ["user=bob", "login: al.ice", "token=abc12345", "password = hunter22", "https://h.example/", "?", "&", "+", " ", "\n\n", " x" * 60, "Zx9" + "aB3" * 6, "AKIA" + "B" * 16, "deadbeef" * 3, "10.0.0.1", "secret: abcdefghijklmn", "/", "user="]
    for _ in range(3_000):
        text = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(2, 12)))
        base = credentials.base_spans(text)
        weak = credentials.weak_spans(text, base)
        values = {m.start(): m.start(2) for m in credentials._ASSIGN.finditer(text)}
        parts = [(s, values[s[0]] if s[2] == "assign" else s[0]) for s in base] + weak
        scope = lambda at: sum(m.end() <= at for m in credentials._BREAK.finditer(text))
        meets = lambda a, b: scope(a[0]) == scope(b[0])
        apart = lambda a, b: a[0][1] <= b[1] or b[0][1] <= a[1]
        want, covered = [], 0
        for part in weak:
            near = [p for p in parts if meets(part[0], p[0])]
            secrets, names = ([p for p in near if p[0][2] in kinds] for kinds in (("assign", "hex", "secret"), ("access", "identifier")))
            pairs = [(a, b) for a in secrets for b in names]
            if part[0][2] == "endpoint":
                linked = any(apart(a, b) or (a[0][2] != "secret" and b[0][2] == "access") for a, b in pairs)
            else:
                linked = any(apart(part, p) for p in (names if part[0][2] == "secret" else secrets))
            if linked and part[0][1] > covered:
                want.append(part[0])
                covered = covered if part[0][2] == "endpoint" else part[0][1]
        assert credentials.linked_spans(text, base) == want, text


def test_secrets_odd(odd, empty):
    rows = {r["doc_id"]: r for r in credentials.find_secrets(odd).collect()}
    assert (rows[0]["spans"], rows[1]["spans"], rows[13]["n_assign"]) == ("", "", 1)
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert credentials.find_secrets(empty).count() == 0
    kept = {r["doc_id"]: r["text"] for r in credentials.redact(odd).select("doc_id", "text").collect()}
    assert kept[0] is None and kept[13] == "<assign>" and kept[11] == "two words"


# -- 9 -------------------------------------------------------------------------------------------


def check_shards(rows, shards=24):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert set(by) <= set(range(shards))
    return [sum(r["size"] for r in by[s]) for s in range(shards)]


def test_kd_shards(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op9_kd_sharding"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode()), "bytes", None) for r in rows)
    sizes = check_shards(rows)
    assert max(sizes) - min(sizes) < 0.12 * sum(sizes) / 24  # a document has up to a third of a shard here
    groups = defaultdict(list)
    for r in rows:
        groups[texts[r["doc_id"]]].append(r)
    groups = [g for g in groups.values() if len(g) > 1]
    small = [g for g in groups if sum(r["size"] for r in g) <= kdshards.GROUP * sum(sizes) / 24]
    assert len(small) >= 20 and all(len({r["shard"] for r in g}) == 1 for g in small)


def test_kd_tree_by_its_definition(spark):
    """Every node is split along its widest dimension, as near the bytes that its sides are to have as keys and PART allow."""
    rows, dims = kdshards.keyed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", ("source", "lang"), 24)
    root = kdshards.grow(rows, dims, 24)
    seen = []

    def walk(node, inside):
        if node.left is None:
            seen.append(node.first)
            assert node.shards == 1
            return
        ranges = {k: max(r[k] for r in inside) - min(r[k] for r in inside) for k in dims}
        assert ranges[node.key] == max(ranges.values())
        total = sum(r["size"] for r in inside)
        goal = total * node.left.shards / node.shards
        sides = [r for r in inside if r[node.key] <= node.bound], [r for r in inside if r[node.key] > node.bound]
        weights = defaultdict(int)
        for r in inside:
            weights[r[node.key]] += r["size"]
        reached, best = 0, total
        for key in sorted(weights):
            reached += weights[key]
            best = min(best, abs(reached - goal))
        assert abs(sum(r["size"] for r in sides[0]) - goal) <= best + 2 * kdshards.PART * total / node.shards
        assert (node.left.shards, node.right.shards) == (node.shards // 2, node.shards - node.shards // 2)
        walk(node.left, sides[0])
        walk(node.right, sides[1])

    walk(root, rows.collect())
    assert seen == list(range(24))


def test_kd_shards_of_small_documents(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    rows = kdshards.shard(frame).collect()
    sizes = check_shards(rows)
    assert max(sizes) < 1.01 * min(sizes)
    assert len({r["shard"] for r in rows if r["doc_id"] % 3 == 0}) > 5  # a group of a third of all rows is split


def test_kd_shards_odd(odd, empty):
    rows = kdshards.shard(odd).collect()
    check_shards(rows)
    got = {r["doc_id"]: r for r in rows}
    assert (got[0]["size"], got[0]["text_crc32"], got[1]["text_crc32"]) == (8, 0, 0)
    assert len(rows) == odd.count()
    assert kdshards.shard(empty).count() == 0


# -- 10 ------------------------------------------------------------------------------------------


def check_fingerprints(rows, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in rows}
    for i, d in enumerate(ids):
        text, after = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    prints = defaultdict(set)
    for d in ids:
        prints[texts[d]].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def test_fingerprints(spark, small, documents):
    rows = QUERIES["op10_closed_syncmers"](spark, small).collect()
    check_fingerprints(rows, {i: r["text"] for i, r in documents.items()})
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95


def test_fingerprints_in_many_ranges(spark, table, documents, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    check_fingerprints(syncmers.fingerprints(table).collect(), {i: r["text"] for i, r in documents.items()})


def test_closed_syncmers_by_definition(spark):
    words = [f"w{i * 7919 % 101}" for i in range(60)]
    frame = spark.createDataFrame([(" ".join(words),)], "text string").select(syncmers.anchors("text").alias("a"), F.expr("transform(split(text, ' '), w -> xxhash64(w))").alias("h"))
    row = frame.first()
    k, s = syncmers.K, syncmers.S
    pairs = spark.createDataFrame([(i, row["h"][i : i + s]) for i in range(len(words) - s + 1)], "i int, h array<long>").select("i", F.xxhash64(*(F.get("h", F.lit(j)) for j in range(s))).alias("v")).collect()
    inner = [r["v"] for r in sorted(pairs)]
    want = [i for i in range(len(words) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert [a["place"] for a in row["a"]] == want
    shifted = spark.createDataFrame([("x y z " + " ".join(words),)], "text string").select(syncmers.anchors("text").alias("a")).first()
    assert {a["hash"] for a in row["a"]} <= {a["hash"] for a in shifted["a"]}


def test_fingerprints_hold_every_anchor(spark):
    """Two texts of 3,000 words that share a passage of 30: the 64 smallest hashes of each would tell nothing of it."""
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"{x}{i}" for i in range(2_000)] + passage + [f"{x}{i}" for i in range(2_000, 2_970)]) for x in "ab"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(syncmers.fingerprints(frame).collect())
    found = [r["a"] for r in frame.orderBy("doc_id").select(syncmers.anchors("text").alias("a")).collect()]
    for row, every in zip(rows, found, strict=True):
        assert len(every) > 1_500
        assert row["fingerprint"] == "".join(f"{a['hash'] % 2**64:016x}{a['place']:08x}" for a in every)
    left, right = ({a["hash"] for a in every} for every in found)
    assert left & right and all(r["near_next"] == pytest.approx(len(left & right) / len(left | right)) for r in rows)
    half = len(texts[0]) // 2
    edited = spark.createDataFrame([(texts[0][: len(texts[0]) - half] + texts[1][:half],)], "text string").select(syncmers.anchors("text").alias("a")).first()["a"]
    other = {a["hash"] for a in edited}
    assert rows[0]["near_edited"] == pytest.approx(len(left & other) / len(left | other))
    assert len(rows[0]["edited_fingerprint"]) == 24 * len(edited)


def test_fingerprints_odd(odd, empty, spark):
    whole = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_fingerprints(syncmers.fingerprints(whole).collect(), {r["doc_id"]: r["text"] for r in whole.select("doc_id", "text").collect()})
    assert syncmers.fingerprints(odd).count() == odd.count()
    assert syncmers.fingerprints(empty).count() == 0
    lone = syncmers.fingerprints(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).first()
    assert (lone["near_next"], lone["edited_sha256"]) == (1.0, hashlib.sha256(b"ab ab").hexdigest())


def test_sets_that_are_forgotten_come_back(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(minhash, "HELD", 5)
    texts = [" ".join(f"w{j}" for j in range(i, i + 9)) for i in range(6)]
    sets = minhash._Sets(pa.chunked_array([texts]), 2)
    for a in range(6):
        for b in range(6):
            if a != b:
                x, y = shingles(texts[a], 2), shingles(texts[b], 2)
                assert sets.shared(a, b) == (len(x & y), len(x | y))
