"""Language identification by compression.

Each language has a zstandard raw-content dictionary of labelled text. A text is encoded, whole, with every dictionary, and
the language with the smallest result wins; the margin to the second says how sure that is, and narrow margins are rejected.

The dictionaries are learned from a bounded sample: the whole texts of at most SAMPLE different ones of each of the LANGUAGES
most frequent languages, those with the smallest hashes of id and text. Everything else covers all rows and whole texts.

Defined cases: a null text, and one without a letter, is `und` with score 0 and rejected. Ties go to the language with
the most learned rows, then to the one that sorts first. With one learned language that one is predicted, with score 1; with none every text is `und`. Rows without a language
are predicted but not learned from. An empty table gives an empty result. Columns other than id, text and language are not
read; the language is read only where rows are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.words import slices
from claimloom.session import spread

SAMPLE, LANGUAGES = 100, 256
#: Texts are encoded in pieces of so many characters, so that what a long text has said before doesn't replace the dictionary.
PIECE = 4_096
LEVEL = 6
#: Below this margin a prediction is rejected.
MARGIN = 0.002
UNKNOWN = "und"
#: Draws are numbers below this.
DRAWS = 1 << 40

_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder: such rows are not learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, the most frequent first, from the rows of docs that are not held out."""
    rows = docs.where(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(DRAWS)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("different"))
    counts = {r["lang"]: r["different"] for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    # twice as many as are wanted, so that hardly ever too few are drawn
    bounds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * SAMPLE / max(1, n)) * DRAWS))))
    drawn = rows.where(F.col("draw") < F.coalesce(F.try_element_at(bounds, F.col("lang")), F.lit(0))).groupBy("lang", "text").agg(F.min("draw").alias("draw"))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("place") <= SAMPLE)
    parts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["place"])):
        parts[r["lang"]].append(r["text"].lower().encode())
    return {lang: b"\n".join(filter(None, x)) for lang, x in parts.items()}


class Classifier:
    """One worker's compressors."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.tools = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text takes with each language's dictionary."""
        low = text.lower()
        pieces = [low[i : i + PIECE].encode() for i in range(0, len(low), PIECE)]
        return [sum(len(tool.compress(p)) for p in pieces) for tool in self.tools]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how much smaller its result is than the second's, as a share of the second's."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        second = sizes[order[1]] if len(order) > 1 else 0
        return self.langs[order[0]], 1 - sizes[order[0]] / second if second else 1.0


_classifiers: dict[int, Classifier] = {}


def _classifier(number: int, sent) -> Classifier:
    if number not in _classifiers:
        _classifiers.clear()
        _classifiers[number] = Classifier(sent.value)
    return _classifiers[number]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """id, lang_pred, score (0 to 1), rejected, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    number = hash(tuple(dictionaries.items()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _classifier(number, sent)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [tool.predict(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(of, f"`{id_col}` {kind}, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    number, at = hash(tuple(dictionaries.items())), docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _classifier(number, sent)
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [tool.predict(x) for x in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([lang != UNKNOWN and score >= margin for lang, score in found], pa.bool_()))

    return spread(docs).mapInArrow(of, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """id, held_out, lang_pred, score, rejected: learns from docs and predicts every row."""
    found = predict(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col, margin)
    return found.withColumn("held_out", F.coalesce(held_out(id_col), F.lit(False))).select(id_col, "held_out", "lang_pred", "score", "rejected")
