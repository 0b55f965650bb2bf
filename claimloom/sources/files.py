"""Files in: directories of documents, tables, and page stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# -- fixed values -----------------------------------------------------------------------
DOCUMENT_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff")
SURVEY_EXTENSIONS = (*DOCUMENT_EXTENSIONS, "bmp")


def _extension():
    return F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))


def directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS, recursive: bool = False) -> DataFrame:
    """path, filename, length, modificationTime, content of the documents in a directory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    globbed = "*.{" + ",".join(x for e in extensions for x in dict.fromkeys((e, e.upper()))) + "}"
    files = reader.option("pathGlobFilter", globbed).load(path)
    return files.where(_extension().isin(*extensions)).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def survey_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Files of a tree, by path; the limit is the caller's."""
    files = directory(spark, root, SURVEY_EXTENSIONS, recursive=True).orderBy("path")
    return files.limit(limit) if limit else files


def bundle(files: DataFrame, case_id: str) -> DataFrame:
    """Files as the arrivals of a case: case_id, arrival (by path), document_id (from content), filename, content, sha256."""
    order = Window.partitionBy("case_id").orderBy("path")
    out = files.withColumns({"case_id": F.lit(case_id), "sha256": F.sha2("content", 256)})
    return out.withColumns({"arrival": F.row_number().over(order), "document_id": F.concat(F.lit("DOC_"), F.left("sha256", F.lit(12)))})


def table(spark: SparkSession, directory_path: str, name: str) -> DataFrame:
    """A parquet table of a folder of tables."""
    return spark.read.parquet(f"{directory_path}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of a text file, in order: one file is read as one row, so that its order is known."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
