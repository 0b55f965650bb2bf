"""MinHash near-duplicates with sequential Bayesian verification.

Signatures of 128 minima come from whole texts. 24 bands of 4 minima propose pairs: a pair at similarity 0.8 shares no
band with probability (1 - 0.8^4)^24 < 4e-6. A proposed pair's signatures are compared in batches of 32; after each batch
the posterior of its similarity, under a uniform prior, says whether the pair may still reach the threshold, and a pair
falls when that probability is under a quarter of ``miss``, so that the four looks together lose at most that share of the
pairs at the threshold. Survivors are confirmed on their full shingle sets.

Groups of copies stay cheap: documents with the same words in the same order, by their SHA-256, form one class and only its
smallest id goes on; a member is first compared with one hub, the smallest id of its buckets. Members of one bucket that are
still in different components then meet in blocks of bounded size, which only let out links that join components: rows of
the bucket's largest component do not meet each other, so one stranger in a large group costs one look at each member.
No bucket, class or hub is held by one task: hot buckets and classes are joined by broadcast, hubs are salted.

Defined cases: null or wordless texts have no shingles, are linked with nothing and are kept. A text of fewer than k words
has its whole word sequence as its one shingle. Rows that share an id count as one document. Ties go to the smaller id.
An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.graph import components
from claimloom.llm.storage import HOT_ROWS, forget, joined, stored
from claimloom.llm.words import Words, mix, slices
from claimloom.session import spread

MINIMA, BANDS, ROWS, BATCH = 128, 24, 4, 32
#: Rows of one bucket that meet each other at once, and shingles of their texts, about.
CHUNK, CHUNK_SHINGLES = 512, 1_000_000
#: Shingles that a block keeps at once.
HELD = 1_000_000
_rng = np.random.default_rng(7919)
_MULTIPLY = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of compared batches, the fewest matches with which P(similarity >= threshold) is that look's share of miss or more.

    With m of n matches and a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss * BATCH / MINIMA:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (distinct shingles), sha (of the lower-case words), signature (128 16-bit minima), bands (24 bucket keys)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column(1), lower=True)
                value, doc = words.shingles(k, words.hashes())
                order = np.lexsort((value, doc))
                value, doc = value[order], doc[order]
                fresh = np.ones(len(value), bool)
                fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                value, doc = value[fresh], doc[fresh]
                rows = np.flatnonzero(np.bincount(doc, minlength=batch.num_rows))
                n = np.bincount(doc, minlength=batch.num_rows)[rows]
                at = np.cumsum(n) - n
                minima = np.zeros((len(rows), MINIMA), np.uint32)
                if len(rows):
                    for p in range(MINIMA):
                        minima[:, p] = np.minimum.reduceat((value * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32), at)
                keys = np.zeros((len(rows), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = mix(keys + minima[:, j : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(j + 1))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _MULTIPLY[0])
                counts = np.zeros(batch.num_rows, np.int64)
                counts[rows] = n
                has = np.zeros(batch.num_rows, bool)
                has[rows] = True
                signature = (minima & np.uint32(0xFFFF)).astype("<u2")
                edges = words.offsets.tolist()
                shas = [hashlib.sha256(b" ".join(words.data[edges[i] : edges[i + 1]].tobytes().split())).digest() if has[i] else None for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts),
                        pa.array(shas, pa.binary()),
                        pa.array([signature[i].tobytes() if i >= 0 else None for i in np.where(has, np.cumsum(has) - 1, -1)], pa.binary()),
                        pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32), keys.reshape(-1).view(np.int64)),
                    ],
                    ["id", "n", "sha", "signature", "bands"],
                )

    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(of, "id long, n long, sha binary, signature binary, bands array<long>")


def _posterior(threshold: float, miss: float):
    """Keeps the pairs (a, b, salt) whose signatures may belong to a similarity of threshold or more."""
    least = least_matches(threshold, miss)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, MINIMA) for i in (3, 4))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, fewest in enumerate(least):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
                alive = alive[matches[alive] >= fewest]
            yield batch.select([0, 1, 2]).take(pa.array(alive))

    return of


def _shingle_set(text: str, k: int) -> set:
    words = text.encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else set(zip(*(words[j:] for j in range(k))))


def _confirm(k: int, percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union of the full shingle sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                left, right = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if known[0] != left:
                    known = (left, _shingle_set(left, k))
                other = _shingle_set(right, k)
                both = len(known[1] & other)
                if both and 100 * both >= percent * (len(known[1]) + len(other) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return of


def links_among(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b, salt) that are linked, as (a, b). Sizes, then signature batches, then full sets decide.

    The salt deals the pairs of one a, which may be a hub of very many, to several tasks.
    """

    def sides(of: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
        left, right = (of.select(F.col("id").alias(f"id_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
        asked = wanted.select(F.col("a").alias("a_"), F.col("salt").alias("salt_")).distinct().join(left, F.col("a_") == F.col("id_a"))
        return wanted.join(right, F.col("b") == F.col("id_b")).join(asked, (F.col("a") == F.col("a_")) & (F.col("salt") == F.col("salt_")))

    near = sides(reps, pairs, ["n", "signature"])
    near = near.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    near = stored(near.select("a", "b", "salt", "signature_a", "signature_b").mapInArrow(_posterior(percent / 100, miss), "a long, b long, salt long").distinct())
    both = sides(texts, near, ["text"])
    linked = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long").distinct())
    forget(near)
    return linked


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (band, block), the first two columns, from batches that are sorted by them."""
    held: list[tuple[tuple, pa.RecordBatch]] = []
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1 if batch.num_rows else np.zeros(0, int)
        edges = [0, *cuts.tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:], strict=False):
            if held and last > first and tuple(key[:, first]) != held[0][0]:
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            if last > first:
                held.append((tuple(key[:, first]), batch.slice(first, last - first)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


def _candidates(group: pa.Table, least: tuple[int, ...], roots: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, later rows of another root whose sizes and signatures pass and that share no earlier bucket; most matches first.

    Rows of two different chunks meet in one block, rows of one chunk only in that chunk's own block. Roots may change meanwhile.
    """
    signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(-1, MINIMA)
    bands = np.concatenate([x.flatten().to_numpy() for x in group.column("bands").chunks]).reshape(len(signature), BANDS)
    chunk, n, place = group.column("chunk").to_numpy(), group.column("n").to_numpy(), int(group.column("place")[0].as_py())
    two = len(np.unique(chunk)) > 1
    for i in range(len(signature) - 1):
        own = (roots[i + 1 :] != roots[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent)
        if two:
            own &= chunk[i + 1 :] != chunk[i]
        later = np.flatnonzero(own) + i + 1
        if place and len(later):
            later = later[~(bands[later, :place] == bands[i, :place]).any(1)]
        matches = np.zeros(len(later), np.int64)
        for step, fewest in enumerate(least):
            part = slice(step * BATCH, (step + 1) * BATCH)
            matches = matches + (signature[later, part] == signature[i, part]).sum(1)
            later, matches = later[matches >= fewest], matches[matches >= fewest]
        if len(later):
            yield i, later[np.argsort(-matches, kind="stable")]


def _hopeful(least: tuple[int, ...], percent: int):
    """Of each block, the rows that have a candidate."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            found: set[int] = set()
            for i, later in _candidates(group, least, group.column("comp").to_numpy(), percent):
                found.update([i, *later.tolist()])
            if found:
                yield from group.take(pa.array(sorted(found))).select(["band", "block", "chunk", "place", "id", "n", "comp"]).combine_chunks().to_batches()

    return of


class _Sets:
    """Shingle sets of a block's rows, as numbers of the block's shingles; forgotten when they hold more than HELD."""

    def __init__(self, texts: pa.ChunkedArray, k: int):
        self.texts, self.k = texts, k
        self.numbers: dict[tuple, int] = {}
        self.sets: dict[int, frozenset] = {}
        self.held = 0

    def _of(self, row: int) -> frozenset:
        if row not in self.sets:
            number = self.numbers.setdefault
            self.sets[row] = frozenset(number(s, len(self.numbers)) for s in _shingle_set(self.texts[row].as_py(), self.k))
            self.held += len(self.sets[row])
        return self.sets[row]

    def shared(self, a: int, b: int) -> tuple[int, int]:
        """Sizes of the intersection and the union of two rows' sets."""
        if self.held > HELD:
            self.numbers, self.sets, self.held = {}, {}, 0
        left, right = self._of(a), self._of(b)
        both = len(left & right)
        return both, len(left) + len(right) - both


def _linked(least: tuple[int, ...], k: int, percent: int):
    """Of each block, links that join its components, confirmed on full sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, sets = group.column("id").to_pylist(), _Sets(group.column("text"), k)
            roots, links = np.array(group.column("comp").to_numpy()), []
            for i, later in _candidates(group, least, roots, percent):
                for j in later.tolist():
                    if roots[i] == roots[j]:
                        continue
                    both, union = sets.shared(i, j)
                    if both and 100 * both >= percent * union:
                        links.append((ids[i], ids[j]))
                        roots[roots == roots[j]] = roots[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return of


def links_across(named: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, miss: float, total: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components. named, of `total` rows at most: band, id, n, comp.

    A bucket is cut into chunks of about CHUNK rows and CHUNK_SHINGLES shingles, those of its largest component apart from
    the rest. Each chunk of the rest meets every chunk in a block, so no task holds a large bucket and members of the largest
    component do not meet. Blocks first meet with signatures alone; the rows that have a candidate meet again with their
    texts. Only links that join components leave a block.
    """
    least = least_matches(percent / 100, miss)
    parts = named.groupBy("band", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("rows", "comp", "shingles")).alias("top"), F.sum("rows").alias("size"), F.sum("shingles").alias("every"), F.count("*").alias("comps")).where("comps > 1")
    chunks = lambda rows, shingles: F.greatest(F.ceil(rows / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("long")
    whole = (F.col("size") <= CHUNK) & (F.col("every") <= CHUNK_SHINGLES)
    mixed = mixed.select(
        "band",
        "size",
        F.when(~whole, F.col("top.comp")).alias("top"),
        F.when(whole, F.lit(1)).otherwise(chunks(F.col("size") - F.col("top.rows"), F.col("every") - F.col("top.shingles"))).cast("long").alias("rest"),
        F.when(whole, F.lit(0)).otherwise(chunks(F.col("top.rows"), F.col("top.shingles"))).cast("long").alias("tops"),
    )
    mixed = stored(mixed)
    open_ = joined(named, mixed, ["band"], "size", total)
    in_top = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    open_ = open_.withColumn("chunk", F.when(in_top, F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("tops", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), "rest")))
    others = F.sequence(F.lit(0).cast("long"), F.when(in_top, F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1)
    block = F.explode(F.transform(others, lambda o: F.least("chunk", o) * (F.col("rest") + F.col("tops")) + F.greatest("chunk", o)))
    sides = reps.select(F.col("id").alias("rep_id"), "signature", "bands")
    open_ = open_.join(sides, F.col("id") == F.col("rep_id")).withColumn("place", (F.array_position("bands", F.col("band")) - 1).cast("long"))
    open_ = open_.where("place >= 0").select("band", block.alias("block"), "chunk", "place", "id", "n", "comp", "signature", "bands")
    grouped = lambda df: df.repartition("band", "block").sortWithinPartitions("band", "block", "id")
    schema = "band long, block long, chunk long, place long, id long, n long, comp long"
    hopeful = stored(grouped(open_).mapInArrow(_hopeful(least, percent), schema))
    rows = hopeful.join(sides, F.col("id") == F.col("rep_id"))
    rows = rows.join(texts.select(F.col("id").alias("text_id"), "text"), F.col("id") == F.col("text_id"))
    rows = grouped(rows.select("band", "block", "chunk", "place", "id", "n", "comp", "signature", "bands", "text"))
    linked = stored(rows.mapInArrow(_linked(least, k, percent), "a long, b long").distinct())
    forget(mixed, hopeful)
    return linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id that links reach), kept (id_col = component_id), a row for each row of docs."""
    every = stored(profiles(docs, id_col, text_col, k))
    total = every.count()
    some = every.where("n > 0")
    classes = stored(some.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    reps = stored(some.join(classes.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id", "sha"]).select("id", "n", "signature", "bands"))
    rows = reps.select("id", "n", F.explode("bands").alias("band"))
    buckets = stored(rows.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("size")).where("hub < last").select("band", "hub", "size"))
    members = stored(joined(rows, buckets, ["band"], "size", BANDS * total).select("band", "id", "n", "hub", "size"))
    involved = members.select(F.col("id").alias("node")).distinct()
    texts = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(involved, F.col("id") == F.col("node"), "left_semi"))

    first = members.where("id > hub").groupBy(F.col("id").alias("b")).agg(F.min(F.struct("hub", "size")).alias("first"))
    first = first.select(F.col("first.hub").alias("a"), "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("first.size") / HOT_ROWS).cast("long")).alias("salt"))
    links = links_among(first, reps, texts, k, percent, miss)
    labels = components(links).select(F.col("node").alias("labelled"), F.col("label").alias("comp"))
    named = stored(members.join(labels, F.col("id") == F.col("labelled"), "left").select("band", "id", "n", F.coalesce("comp", "id").alias("comp")))
    forget(buckets, members)
    more = links_across(named, reps, texts, k, percent, miss, BANDS * total)
    forget(named, reps, texts)
    labels = components(links.unionByName(more))

    # a class's component is looked up once, not once for each of its rows
    found = stored(classes.join(labels, F.col("rep") == F.col("node"), "left").select("sha", "size", F.coalesce("label", "rep").alias("component_id")))
    out = joined(some.select("id", "n", "sha"), found, ["sha"], "size", total).select("id", "n", "component_id")
    out = stored(out.unionByName(every.where("n = 0").select("id", "n", F.col("id").alias("component_id"))))
    forget(links, more, classes, found, every)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
