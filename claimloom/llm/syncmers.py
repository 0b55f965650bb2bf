"""Document fingerprints of closed syncmers. DataFrame and SQL functions only.

A k-mer is K consecutive words. It is an anchor when the smallest of its S-word substrings lies at one of its two edges. That
depends on the k-mer alone, so the same words give the same anchors wherever they stand. A fingerprint is every anchor with its
place, and the likeness of two texts is the Jaccard similarity of their whole sets of anchor hashes.

Edited texts need the next document. Documents are dealt to ranges of ids (bounds from an approximate percentile, some
thousand rows each); the first document of a range is also sent to the range before, the very first to the last. The next
document is then the next row of the same range, and every text crosses the network once.

Defined cases: a null text counts as empty. Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than K words has one anchor,
its whole word sequence, and a text without words has none. Two fingerprints without anchors have likeness 1. Null ids come
first; rows that share an id are ordered by text. The next of a lone row is itself. An empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

K, S = 4, 2
#: Rows of a range, about, and the most ranges: bounds are literals of the plan.
RANGE_ROWS, RANGES = 1_000, 4_096


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _anchors(text: str, item: str) -> str:
    """SQL array of `item` for each anchor; item may use i (its first word's place) and h (word hashes)."""
    last = K - S
    edge = f"least(s[i], s[i + {last}])"
    picked = f"filter(sequence(0, size(h) - {K}), i -> {' and '.join(f'{edge} <= s[i + {j}]' for j in range(1, last))})"
    substrings = f"transform(sequence(0, size(h) - {S}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(S))}))"
    many = _let("s", substrings, f"transform({picked}, i -> {item})")
    few = "transform(array(0), i -> " + item.replace(_HASH, "xxhash64(h, 1)") + ")"
    words = rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
    return _let("h", f"transform({words}, w -> xxhash64(w))", f"if(size(h) >= {K}, {many}, if(size(h) > 0, {few}, cast(array() as array<{{kind}}>)))")


_HASH = f"xxhash64({', '.join(f'h[i + {j}]' for j in range(K))})"


def anchors(text: str) -> Column:
    """array<struct<place, hash>>: every anchor of the text column and the place of its first word."""
    sql = _anchors(f"coalesce({text}, '')", f"named_struct('place', i, 'hash', {_HASH})")
    return F.expr(sql.replace("{kind}", "struct<place:int,hash:bigint>"))


def fingerprint(hashes: str, places: str) -> Column:
    """Anchors as text, by place: 16 hexadecimal digits of the hash and 8 of the place for each."""
    digits = F.zip_with(hashes, places, lambda h, p: F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(p), 8, "0")))
    return F.lower(F.array_join(digits, ""))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def dealt(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """docs (id, text) dealt to ranges of ids, with lent = 1 on rows lent to the range before, and the order in which the next row is the next document."""
    known = docs.agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.min("id").alias("low")).first()
    parts = max(1, min(RANGES, known["ids"] // RANGE_ROWS))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else None
    found = docs.agg(F.percentile_approx("id", shares, 20 * RANGES).alias("at")).first()["at"] if shares is not None else []
    bounds = sorted({x for x in found if x > known["low"]})
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    listed = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})" if xs else "cast(array() as array<bigint>)"
    if bounds:
        groups = f"array({', '.join(listed(bounds[i : i + step]) for i in range(0, len(bounds), step))})"
        below = f"size(filter({listed(coarse)}, b -> b <= id))"
        part = F.expr(_let("c", f"coalesce({below}, 0)", f"if(c = 0, 0, (c - 1) * {step} + size(filter({groups}[c - 1], b -> b <= id)))"))
        opens = F.expr(f"array_contains({listed(bounds)}, id)")
    else:
        part, opens = F.lit(0), F.lit(False)
    first = F.col("id").isNull() if known["ids"] < known["rows"] else F.col("id") == F.lit(known["low"])
    total = len(bounds) + 1
    placed = docs.withColumn("part", part)
    again = F.when(first, F.lit(total - 1)).when(F.coalesce(opens, F.lit(False)), F.col("part") - 1)
    copies = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("lent")), F.when(again.isNotNull(), F.struct(again.alias("part"), F.lit(1).alias("lent")))))
    sent = placed.withColumn("to", F.explode(copies)).withColumn("part", F.col("to.part")).withColumn("lent", F.col("to.lent")).drop("to")
    order = Window.partitionBy("part").orderBy("lent", F.col("id").asc_nulls_first(), "text")
    return sent.repartition("part"), order


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has the last half of the text replaced by the start of the next document.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sent, order = dealt(plain)
    sent = _split(sent.withColumn("anchors", anchors("text")), "")
    paired = sent.select("id", "text", "hashes", "places", "lent", F.lead("text").over(order).alias("next_text"), F.lead("hashes").over(order).alias("next_hashes")).where("lent = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    paired = paired.select("id", F.length("text").cast("long").alias("n_chars"), "hashes", "places", "next_hashes", edited.alias("edited"))
    paired = paired.select("id", "n_chars", "hashes", "places", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"), anchors("edited").alias("anchors"))
    paired = _split(paired, "edited_").withColumns({f"{x}set": F.array_distinct(f"{x}hashes") for x in ("", "next_", "edited_")})
    return paired.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint("hashes", "places").alias("fingerprint"),
        fingerprint("edited_hashes", "edited_places").alias("edited_fingerprint"),
        likeness("set", "edited_set").alias("near_edited"),
        likeness("set", "next_set").alias("near_next"),
    )


def _split(df: DataFrame, name: str) -> DataFrame:
    """df with the column anchors as two flat arrays, which are a third of its size."""
    return df.withColumns({f"{name}hashes": F.col("anchors.hash"), f"{name}places": F.col("anchors.place")}).drop("anchors")
