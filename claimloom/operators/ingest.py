"""Files before anything is read from them: format, safety, identity, quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- fixed values -----------------------------------------------------------------------
MAGIC = (("pdf", "255044462D"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A"))
EXTENSIONS = {"pdf": ("pdf",), "png": ("png",), "jpeg": ("jpg", "jpeg"), "tiff": ("tif", "tiff")}
CAPABILITIES = (
    ("/JavaScript", "PDF_JAVASCRIPT", True),
    ("/JS", "PDF_JAVASCRIPT", True),
    ("/Launch", "PDF_LAUNCH", True),
    ("/EmbeddedFile", "PDF_EMBEDDED_FILE", True),
    ("/RichMedia", "PDF_RICH_MEDIA", True),
    ("/GoToR", "PDF_REMOTE_GOTO", True),
    ("/SubmitForm", "PDF_SUBMIT_FORM", True),
    ("/OpenAction", "PDF_OPEN_ACTION", False),
    ("/AA", "PDF_ADDITIONAL_ACTIONS", False),
    ("/XFA", "PDF_XFA", False),
)
DIGITAL_CHARS, SCANNED_CHARS = 200, 20
DPI_RANGE = (10, 2400)
REJECT_DPI, MIN_DPI, MIN_SHARPNESS, MAX_PAGES = 100.0, 200.0, 60.0, 800


def sniff(content: Column, magic: tuple[tuple[str, str], ...] = MAGIC) -> Column:
    """The format that the first bytes say; the first that fits, null if none."""
    out = F.lit(None).cast("string")
    for name, head in reversed(magic):
        out = F.when(F.startswith(content, F.unhex(F.lit(head))), name).otherwise(out)
    return out


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def token_codes(content: Column, tokens: tuple[tuple[str, str, bool], ...] = CAPABILITIES, blocking: bool | None = None) -> Column:
    """Codes of the tokens that content holds, each once."""
    found = [F.when(F.contains(content, F.lit(t).cast("binary")), code) for t, code, b in tokens if blocking is None or b == blocking]
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan(files: DataFrame, content: str = "content", name: str = "filename") -> DataFrame:
    """files with file_type, safety_codes and verdict: BLOCKED, SUSPICIOUS or SAFE."""
    kind = sniff(F.col(content))
    expected = F.try_element_at(F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), kind)
    ext = extension(F.col(name))
    tail = F.decode(F.substring(content, -2048, 2048), "ISO-8859-1")
    pdf = kind == "pdf"
    hard = F.when(pdf, token_codes(F.col(content), blocking=True)).otherwise(F.array().cast("array<string>"))
    soft = F.when(pdf, token_codes(F.col(content), blocking=False)).otherwise(F.array().cast("array<string>"))
    mismatch = F.when((ext != "") & ~F.array_contains(expected, ext), "EXTENSION_MISMATCH")
    cut = F.when(pdf & ~tail.rlike(r"%%EOF\s*$"), "PDF_TRUNCATED")
    codes = F.when(kind.isNull(), F.array(F.lit("UNRECOGNISED_FORMAT"))).otherwise(F.concat(F.array_compact(F.array(mismatch)), hard, soft, F.array_compact(F.array(cut))))
    verdict = F.when(kind.isNull() | (F.size(hard) > 0), "BLOCKED").when(F.size("safety_codes") > 0, "SUSPICIOUS").otherwise("SAFE")
    return files.withColumns({"file_type": kind, "safety_codes": codes}).withColumn("verdict", verdict)


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicates(files: DataFrame, key: str = "sha256", case: str = "case_id", order: str = "arrival", ident: str = "document_id") -> DataFrame:
    """files with duplicate_of: the first document of the case with the same content; null for that first one."""
    same = Window.partitionBy(case, key).orderBy(order, ident)
    return files.withColumn("duplicate_of", F.when(F.row_number().over(same) > 1, F.first(ident).over(same)))


def route(scanned: DataFrame, allow_suspicious: bool = True) -> DataFrame:
    """scanned files with stored and skip_reason. Blocked ones, and suspicious ones if they are not allowed, are never stored."""
    reason = F.when(F.col("verdict") == "BLOCKED", "blocked").when((F.col("verdict") == "SUSPICIOUS") & F.lit(not allow_suspicious), "suspicious").when(F.col("duplicate_of").isNotNull(), "duplicate")
    return scanned.withColumn("skip_reason", reason).withColumn("stored", reason.isNull())


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Counts per case: submitted, accepted, blocked, duplicates, rejected_quality, degraded, needs_ocr."""
    accepted = F.col("skip_reason").isNull() & (F.coalesce("quality", F.lit("OK")) != "REJECTED")
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy("case_id").agg(
        F.count("*").alias("submitted"),
        count(accepted, "accepted"),
        count(F.col("verdict") == "BLOCKED", "blocked"),
        count(F.col("duplicate_of").isNotNull(), "duplicates"),
        count(F.col("quality") == "REJECTED", "rejected_quality"),
        count(F.col("quality") == "DEGRADED", "degraded"),
        count(accepted & F.coalesce("needs_ocr", F.lit(False)), "needs_ocr"),
    )


def text_layer(median_chars: Column, pages: Column) -> Column:
    """DIGITAL, SCANNED or MIXED by the median characters of a page; UNKNOWN without pages."""
    return F.when(F.coalesce(pages, F.lit(0)) == 0, "UNKNOWN").when(median_chars >= DIGITAL_CHARS, "DIGITAL").when(median_chars <= SCANNED_CHARS, "SCANNED").otherwise("MIXED")


def document_metrics(pages: DataFrame, keys: tuple[str, ...] = ("case_id", "document_id")) -> DataFrame:
    """Per document, from pages (text_chars, devanagari, other_indic, latin, rotation, width, height, dpi, sharpness)."""
    letters = F.sum(F.col("devanagari") + F.col("other_indic") + F.col("latin"))
    out = pages.groupBy(*keys).agg(
        F.count("*").alias("page_count"),
        F.median("text_chars").alias("median_chars"),
        F.round(F.try_divide(F.sum(F.col("devanagari") + F.col("other_indic")), letters), 4).alias("non_latin_ratio"),
        F.count_if(F.pmod("rotation", F.lit(360)) != 0).alias("rotated_pages"),
        F.count_distinct(F.struct(F.round("width").alias("w"), F.round("height").alias("h"))).alias("distinct_page_sizes"),
        F.min(F.when((F.col("dpi") > DPI_RANGE[0]) & (F.col("dpi") < DPI_RANGE[1]), F.col("dpi"))).alias("min_dpi"),
        F.median("sharpness").alias("median_sharpness"),
    )
    out = out.withColumn("text_layer", text_layer(F.col("median_chars"), F.col("page_count")))
    return out.withColumn("needs_ocr", F.col("text_layer") != "DIGITAL")


def quality_gate(info: DataFrame) -> DataFrame:
    """info with quality_notes and quality. The first hard failure alone rejects; any other note degrades.

    info: ok, encrypted, page_count, text_layer, min_dpi, median_sharpness, rotated_pages, distinct_page_sizes.
    """
    hard = (
        F.when(F.col("encrypted"), "ENCRYPTED").when(~F.col("ok"), "UNPARSEABLE").when(F.col("page_count") == 0, "NO_PAGES").when(F.col("page_count") > MAX_PAGES, "TOO_MANY_PAGES")
    )
    ocr = F.col("text_layer") != "DIGITAL"
    soft = [
        F.when(ocr & (F.col("min_dpi") < REJECT_DPI), "VERY_LOW_RESOLUTION").when(ocr & (F.col("min_dpi") < MIN_DPI), "LOW_RESOLUTION"),
        F.when(ocr & F.col("median_sharpness").isNull(), "UNMEASURED_SHARPNESS").when(ocr & (F.col("median_sharpness") < MIN_SHARPNESS), "BLURRY"),
        F.when(F.col("text_layer") == "MIXED", "PARTIAL_TEXT_LAYER").when((F.col("text_layer") == "SCANNED") & F.col("min_dpi").isNull(), "NO_TEXT_AND_LOW_RESOLUTION"),
        F.when(F.col("rotated_pages") > 0, "ROTATED_PAGES"),
        F.when(F.col("distinct_page_sizes") > 1, "MIXED_PAGE_SIZES"),
    ]
    notes = F.when(hard.isNotNull(), F.array(hard)).otherwise(F.array_compact(F.array(*soft)))
    verdict = F.when(hard.isNotNull(), "REJECTED").when(F.size(notes) > 0, "DEGRADED").otherwise("OK")
    return info.withColumns({"quality_notes": notes, "quality": verdict})


def quality_metrics(info_columns: tuple[str, ...] = ("page_count", "text_layer", "median_chars", "min_dpi", "median_sharpness", "rotated_pages", "distinct_page_sizes", "non_latin_ratio", "needs_ocr")) -> Column:
    """The measures behind a verdict, as one struct."""
    return F.struct(*info_columns)


PAGE_INFO = "page int, rotation int, width double, height double, text_chars int, devanagari int, other_indic int, latin int, dpi double, sharpness double"


def analysed(files: DataFrame, analysers: dict[str, Callable[[bytes], list[dict]]], keys: tuple[str, ...] = ("case_id", "document_id"), content: str = "content") -> DataFrame:
    """keys, ok, error and a row of PAGE_INFO for each page of each file.

    analysers go by file type; each takes a file's bytes to its pages. A file without an analyser, or that its analyser can't
    read, is one row that says so.
    """
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.strip().split(" ")[0] for part in PAGE_INFO.split(",")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                held = {k: getattr(row, k) for k in keys}
                analyse = analysers.get(row.file_type)
                try:
                    found = analyse(bytes(getattr(row, content))) if analyse else []
                    rows += [held | {"ok": True, "error": None} | {n: p.get(n) for n in names} for p in found]
                    if not found:
                        rows.append(held | {"ok": bool(analyse), "error": None if analyse else "no analyser", **dict.fromkeys(names)})
                except Exception as e:  # one file's failure is that file's row
                    rows.append(held | {"ok": False, "error": str(e), **dict.fromkeys(names)})
            out = pd.DataFrame(rows, columns=[*keys, "ok", "error", *names])
            yield out.astype({n: "Int32" if n not in ("width", "height", "dpi", "sharpness") else "float64" for n in names})

    return files.select(*keys, sniff(F.col(content)).alias("file_type"), content).mapInPandas(of, f"{kinds}, ok boolean, error string, {PAGE_INFO}")
