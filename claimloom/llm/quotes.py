"""Chat formatting by quotation linking.

A message's lines are cut by quote level, the number of `>` before the text; attribution lines before a quote ("... wrote:")
belong to the quote. Quoted paragraphs, and their single lines, are normalised (white space collapsed, case folded) and hashed;
the hashes are joined, within a conversation, to the paragraphs and lines that earlier messages say themselves. Each outermost
linked passage speaks for the latest earlier message that says it, with the weight of its letters; a message replies to the
one with the most weight. So a quoted "Yes." doesn't turn a reply away from the message whose paragraph is quoted. Messages
that hang together by replies are a thread, named after its first turn; a conversation in reply order is its messages by
thread, then turn, without the quotes: a message stands after all that it replies to.

The latest earlier message is a running maximum over turns, within spans of turns and then over them, so a common passage
doesn't meet itself and no task holds all that is said of it. Threads follow reply links by doubling.

Defined cases: a null text has no passages and stays null. A quote of nothing that was said earlier in the conversation links
nothing and is removed all the same. A passage said twice counts as the later one before the quote; of messages with equal
weight the latest is replied to. Rows that share
conversation and turn are one message to links. Null conversations or turns are not linked. An empty table gives an empty
result. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored
from claimloom.llm.words import slices

#: Turns of a span.
SPAN = 4_096

_MARK = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
_ATTRIBUTION = re.compile(r"^.{0,200}(?:wrote|writes|said|schrieb|a écrit|escribió) ?:\s*$", re.IGNORECASE)


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line; an attribution line has the level of the quote that follows."""
    out = []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        out.append((mark[0].count(">"), line[mark.end() :]) if mark else (0, line))
    for i in range(len(out) - 2, -1, -1):
        level, line = out[i]
        after = next((x for x in out[i + 1 : i + 3] if x[1].strip()), (0, ""))
        if after[0] > level and _ATTRIBUTION.match(line):
            out[i] = (after[0], "")
    return out


def _hash(line: str) -> int | None:
    line = " ".join(line.split()).casefold()
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True) if line else None


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(level, hash, letters) of every paragraph, a run of lines of one level without an empty one, and of every line."""
    out, run, at = set(), [], None
    for level, line in [*lines, (-1, "")]:
        if run and (level != at or not line.strip()):
            out.add((at, _hash(" ".join(run)), _letters(" ".join(run))))
            run = []
        if line.strip():
            run.append(line)
            at = level
            out.add((level, _hash(line), _letters(line)))
    return sorted(x for x in out if x[1] is not None)


def _letters(line: str) -> int:
    return len("".join(line.split()))


def unquoted(lines: list[tuple[int, str]]) -> str:
    """What the message says itself: lines at level 0, runs of empty lines where a quote stood closed up."""
    if all(level == 0 for level, _ in lines):
        return "\n".join(line for _, line in lines)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line if level == 0 else "" for level, line in lines)).strip("\n")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("letters", pa.int64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            own, quoted, said = [], [], []
            for text in batch.column(3).to_pylist():
                lines = levels(text) if text is not None else []
                found = passages(lines)
                own.append(None if text is None else unquoted(lines))
                quoted.append([{"level": level, "hash": h, "letters": n} for level, h, n in found if level])
                said.append(sorted({h for level, h, _ in found if not level}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(quoted, kind), pa.array(said, pa.list_(pa.int64()))], ["conv", "turn", "role", "own", "quoted", "said"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, thread, depth, reply_to, n_quotes, n_linked, text (without quotes) for each row of messages.

    reply_to is null where no quote is linked; thread is then the own turn, and depth 0. n_quotes counts quoted paragraphs
    and lines, n_linked those that an earlier message says.
    """
    plain = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = stored(plain.mapInArrow(_parsed, "conv long, turn long, role string, own string, quoted array<struct<level:int,hash:long,letters:long>>, said array<long>"))
    quoted = rows.where(F.size("quoted") > 0).select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.level", "q.hash", "q.letters").distinct()
    asked = quoted.select(F.col("conv").alias("conv_"), F.col("hash").alias("hash_")).distinct()
    said = rows.select("conv", F.col("turn").alias("source"), F.explode("said").alias("hash"))
    said = said.join(asked, (F.col("conv") == F.col("conv_")) & (F.col("hash") == F.col("hash_")), "left_semi").distinct()
    met = latest_before(quoted, said).groupBy("conv", "turn", "level", "source").agg(F.sum("letters").alias("weight"), F.count("*").alias("passages"))
    order = F.struct("level", (-F.col("weight")).alias("light"), (-F.col("source")).alias("late"))
    links = met.groupBy("conv", "turn").agg(F.min(order).alias("best"), F.sum("passages").alias("n_linked"))
    links = stored(links.select("conv", "turn", (-F.col("best.late")).alias("reply_to"), "n_linked"))
    known = chains(links).withColumnsRenamed({"conv": "of_conv", "turn": "of_turn"})
    out = rows.join(known, (F.col("conv") == F.col("of_conv")) & (F.col("turn") == F.col("of_turn")), "left")
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "reply_to",
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own").alias(text_col),
    )


def latest_before(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """quoted (conv, turn, level, hash, letters) with source, the latest turn before it in which said (conv, hash, source) has the hash."""
    span = F.floor(F.col("turn") / SPAN).alias("span")
    heard = said.select("conv", "hash", F.col("source").alias("turn"), span)
    asked = quoted.select("conv", "hash", "turn", span, F.struct("level", "letters").alias("quote"))
    every = heard.withColumn("quote", F.lit(None).cast(asked.schema["quote"].dataType)).unionByName(asked)
    within = Window.partitionBy("conv", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = every.withColumn("near", F.max(F.when(F.col("quote").isNull(), F.col("turn"))).over(within)).where("quote is not null")
    spans = every.groupBy("conv", "hash", "span").agg(F.max(F.when(F.col("quote").isNull(), F.col("turn"))).alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = spans.select("conv", "hash", "span", F.max("last").over(before).alias("far"))
    found = near.join(far, ["conv", "hash", "span"]).withColumn("source", F.coalesce("near", "far")).where("source is not null")
    return found.select("conv", "turn", "quote.level", "hash", "quote.letters", "source")


def chains(links: DataFrame) -> DataFrame:
    """links (conv, turn, reply_to, n_linked) with thread, where the chain of replies begins, and depth, its length."""
    at = links.withColumns({"thread": F.col("reply_to"), "depth": F.lit(1).cast("long")})
    while True:
        via = at.select(F.col("conv").alias("via_conv"), F.col("turn").alias("via"), F.col("thread").alias("further"), F.col("depth").alias("steps"))
        joined = at.join(via, (F.col("conv") == F.col("via_conv")) & (F.col("thread") == F.col("via")), "left")
        new = stored(joined.select("conv", "turn", "reply_to", "n_linked", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return at


def reply_ordered(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linked messages as conversations in reply order: sorted by conversation, thread and turn, a range of them in each partition."""
    return linked.repartitionByRange(conv_col, "thread", turn_col).sortWithinPartitions(conv_col, "thread", turn_col)
