"""Passages that repeat across documents, by level-wise doubling.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. The first level has windows of a quarter of the target length; only where such a
window repeats in another document is it extended to twice its length, and only where that repeats again are windows of the
target length formed. The levels end there, or before, when no candidate survives. Longer windows would remove nothing more;
`repeat_levels` goes on doubling beyond the target for those who ask how long passages are.

A level needs few of its windows. Of the quarter windows in a target window the one with the smallest hash is the same
wherever the target window stands, and so is its extension (to the right where that stays inside the target window, else to
the left). A target window that repeats has therefore both of them repeated: no repeated window is lost.

Documents with the same word sequence, by its SHA-256, form a class and only the smallest id goes on; every window of the
others starts in it. Target windows are named by 128 bits: two hashes with unrelated random numbers, each a tree of mixed
pairs, so that no pattern of words collides more often than by chance. Keys that very many rows share are joined by broadcast.

Defined cases: null and wordless texts have no words and lose none. Windows never cross documents. A window that repeats in
its own document alone is no repeat. Rows that share id and text are judged alike; a window must start under a strictly
smaller id, and rows without an id lose nothing. An empty table gives an empty result. Columns other than id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.storage import forget, joined, stored
from claimloom.llm.words import Words, mix, slices
from claimloom.session import spread

#: Odd random numbers, a pair for each of the two hash functions.
_PAIR = np.array([[0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]], np.uint64)


def _paired(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    return mix(left * _PAIR[which, 0] + right * _PAIR[which, 1])


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `length` words; place i has words i to i + length - 1, across rows too.

    Runs of 1, 2, 4 ... words are paired with their neighbours, and those that make up `length` with each other.
    """
    out, width, size, run = hashes[:0], 0, 1, hashes
    while size <= length:
        if length & size:
            n = max(0, len(hashes) - width - size + 1)
            out = _paired(out[:n], run[width : width + n], which) if width else run[:n]
            width += size
        run, size = _paired(run[:-size], run[size:], which), 2 * size
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    size, low = 1, values
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _places(words: Words, length: int) -> np.ndarray:
    """Places where a window of `length` words of one row starts."""
    return np.flatnonzero(np.arange(len(words.doc)) + length <= words.first[words.doc + 1]) if len(words.doc) else np.zeros(0, np.int64)


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first minimum of each run of `width` values."""

    def lower(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[left] <= values[right], left, right)

    size, at = 1, np.arange(len(values))
    while 2 * size <= width:
        at = lower(at[:-size], at[size:])
        size *= 2
    rest = width - size
    return lower(at[: len(at) - rest], at[rest:]) if rest else at


def quarter(length: int) -> int:
    """Words of a window of the first level."""
    return max(1, length // 4)


def _anchors(words: Words, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the target windows, and for each the smallest hash of its quarter windows."""
    at, base = _places(words, length), quarter(length)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, _smallest(window_hashes(hashes, base), length - base + 1)[at]


def _extensions(words: Words, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the target windows, the smallest hash of each's quarter windows, and the hash of that one's extension."""
    at, base = _places(words, length), quarter(length)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    quarters = window_hashes(hashes, base)
    low = _first_smallest(quarters, length - base + 1)[at]
    start = np.where(low - at + 2 * base <= length, low, low - base)
    return at, quarters[low], window_hashes(hashes, 2 * base)[start]


def _sha(text: str | None) -> bytes:
    """SHA-256 of the words joined by one space."""
    return hashlib.sha256(b" ".join((text or "").encode().split())).digest()


def _tag(sha: bytes) -> int:
    return int.from_bytes(sha[:4], "little")


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows (id, tag, text, ...) whose tag is their text's: rows that share an id with another text meet its tag too."""
    tags = [_tag(_sha(x)) for x in batch.column(2).to_pylist()]
    return batch.filter(pa.array(np.array(tags, np.int64) == batch.column(1).to_numpy()))


def _distinct(values: np.ndarray, doc: np.ndarray, rows: int) -> pa.ListArray:
    """The distinct values of each row, as lists."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=rows))))
    return pa.ListArray.from_arrays(ends.astype(np.int32), values[fresh].view(np.int64))


def _among(values: np.ndarray, doc: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its row."""
    known = lists.flatten().to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    salt = _PAIR[0, 0]
    pairs, asked = np.sort(mix(known) + owner.astype(np.uint64) * salt), mix(values) + doc.astype(np.uint64) * salt
    found = np.searchsorted(pairs, asked)
    return (found < len(pairs)) & (pairs[np.minimum(found, len(pairs) - 1)] == asked) if len(pairs) else np.zeros(len(values), bool)


def profiles(docs: DataFrame, length: int) -> DataFrame:
    """A row for each of docs (id, text): n_words, sha and tag of the joined words, its anchors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1))
                at, low = _anchors(words, length, words.hashes())
                shas = [_sha(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words.count, pa.int64()), pa.array(shas, pa.binary()), pa.array(map(_tag, shas), pa.int64()), _distinct(low, words.doc[at], batch.num_rows)],
                    ["id", "n_words", "sha", "tag", "anchors"],
                )

    return spread(docs).mapInArrow(of, "id long, n_words long, sha binary, tag long, anchors array<long>")


def _extended(length: int):
    """For rows (id, tag, text, hs), the extensions of their anchors among hs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in map(_own, slices(whole, "text")):
                if batch.num_rows:
                    words = Words(batch.column(2))
                    at, low, longer = _extensions(words, length, words.hashes())
                    hit = _among(low, words.doc[at], batch.column(3))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _distinct(longer[hit], words.doc[at][hit], batch.num_rows)], ["id", "tag", "hs"])

    return of


def _target_windows(length: int):
    """For rows (id, tag, text, hs), the target windows whose extended anchor is among hs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in map(_own, slices(whole, "text")):
                if not batch.num_rows:
                    continue
                words = Words(batch.column(2))
                hashes = words.hashes()
                at, _, longer = _extensions(words, length, hashes)
                at = at[_among(longer, words.doc[at], batch.column(3))]
                if not len(at):
                    continue
                w0, w1 = window_hashes(hashes, length)[at], window_hashes(words.hashes(1), length, 1)[at]
                # a window that stands several times in a text is one row with its places
                order = np.lexsort((at, w1, w0, words.doc[at]))
                at, w0, w1, doc = at[order], w0[order], w1[order], words.doc[at][order]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1]) | (doc[1:] != doc[:-1])
                rows = pa.array(doc[fresh])
                places = pa.ListArray.from_arrays(np.append(np.flatnonzero(fresh), len(at)).astype(np.int32), (at - words.first[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w0[fresh].view(np.int64)), pa.array(w1[fresh].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), places],
                    ["w0", "w1", "id", "tag", "places"],
                )

    return of


def _without(length: int):
    """For rows (id, tag, text, places), what is left when the windows at places go."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_own, batches):
            gone, left = [], []
            for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, places, 1)
                np.add.at(step, np.asarray(places) + length, -1)
                covered = np.cumsum(step)[:-1] > 0
                gone.append(int(covered.sum()))
                left.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(left, pa.large_string()).cast(pa.string())], ["id", "tag", "n_removed", "kept_text"])

    return of


def classes(prof: DataFrame) -> DataFrame:
    """sha, rep (the smallest id with that word sequence), size (its rows)."""
    return stored(prof.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("size")))


def _again(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, which are a table, whose keys stand under several ids, the smallest of which is low; and the table of such keys."""
    groups = stored(rows.groupBy(*keys).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high").drop("high"))
    return joined(rows, groups, keys, "size", rows.count()).drop("size"), groups


def _windows(listed: DataFrame) -> DataFrame:
    """(id, tag, h) from (id, tag, hs), each once."""
    return stored(listed.select("id", "tag", F.explode("hs").alias("h")).distinct())


def _survivors(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of texts (id, text, and tag if it is known) that have windows which repeat under another id, as (id, tag, text, hs).

    An id that several texts share meets the windows of all of them, and `_own` tells them apart by the tag.
    """
    again, groups = _again(windows, ["h"])
    hits = again.groupBy(F.col("id").alias("hit_id"), F.col("tag").alias("hit_tag")).agg(F.collect_list("h").alias("hs"))
    met = F.col("id") == F.col("hit_id")
    if "tag" in texts.columns:
        met &= F.col("tag") == F.col("hit_tag")
    out = stored(texts.select("id", "text", *(["tag"] if "tag" in texts.columns else [])).join(hits, met).select("id", F.col("hit_tag").alias("tag"), "text", "hs"))
    forget(windows, groups)
    return out


def repeated_windows(docs: DataFrame, prof: DataFrame, same: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Texts (id, tag, text, hs) with a repeated window of half the length, and (w0, w1, id, tag, places, low) of the target
    windows that start under several ids, the smallest of which is low.
    """
    reps = joined(prof, same, ["sha"], "size", prof.count()).where((F.col("id") == F.col("rep")) & (F.size("anchors") > 0))
    listed = reps.select("id", "tag", F.col("anchors").alias("hs"))
    names = "id long, tag long, hs array<long>"
    some = _survivors(_windows(listed), docs)
    texts = _survivors(_windows(some.mapInArrow(_extended(length), names)), some)
    forget(some)
    windows = stored(texts.mapInArrow(_target_windows(length), "w0 long, w1 long, id long, tag long, places array<int>"))
    return texts, _again(windows, ["w0", "w1"])[0]


def repeat_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id_col, place, words: each window of `length` words that repeats in another document, with the largest doubling of that
    length at which the window at its place still repeats.

    Survivors of a level alone are extended: two that stand one length apart make one of twice the length, named by both
    names. Levels end when no candidate survives. Documents with the same word sequence count as one, the smallest id.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prof = stored(profiles(plain, length))
    _, found = repeated_windows(plain, prof, classes(prof), length)
    alive = stored(found.select("w0", "w1", "id", "tag", F.explode("places").alias("place")))
    levels = alive.select("id", "tag", "place", F.lit(length).alias("words"))
    while alive.limit(1).count():
        after = alive.select(F.col("w0").alias("v0"), F.col("w1").alias("v1"), F.col("id").alias("of"), F.col("tag").alias("of_tag"), F.col("place").alias("at"))
        pairs = alive.join(after, (F.col("id") == F.col("of")) & (F.col("tag") == F.col("of_tag")) & (F.col("place") + length == F.col("at")))
        longer = stored(pairs.select(F.xxhash64("w0", "v0").alias("w0"), F.xxhash64("v1", "w1").alias("w1"), "id", "tag", "place"))
        again = longer.groupBy("w0", "w1").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w0", "w1")
        alive, length = stored(longer.join(again, ["w0", "w1"])), 2 * length
        levels = levels.unionByName(alive.select("id", "tag", "place", F.lit(length).alias("words")))
    out = levels.groupBy("id", "tag", "place").agg(F.max("words").alias("words"))
    return out.select(F.col("id").alias(id_col), "place", "words")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text (null where nothing went)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prof = stored(profiles(plain, length))
    same = classes(prof)
    texts, places = repeated_windows(plain, prof, same, length)
    held = places.where("id > low").groupBy("id", "tag").agg(F.flatten(F.collect_list("places")).alias("places")).withColumnsRenamed({"id": "of_id", "tag": "of_tag"})
    cut = texts.select("id", "tag", "text").distinct().join(held, (F.col("id") == F.col("of_id")) & (F.col("tag") == F.col("of_tag"))).select("id", "tag", "text", "places")
    cut = cut.mapInArrow(_without(length), "id long, tag long, n_removed long, kept_text string").withColumnsRenamed({"id": "cut_id", "tag": "cut_tag"})
    rows = joined(prof.drop("anchors"), same, ["sha"], "size", prof.count())
    rows = rows.join(cut, (F.col("id") == F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= length)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("n_removed") > 0, F.sha2("kept_text", 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(F.col("n_removed") > 0, F.col("kept_text")).alias("kept_text"),
    )
