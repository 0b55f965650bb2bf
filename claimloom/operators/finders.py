"""Field finders: what a page says, as rows (field text, value, span).

Values come from literal patterns inside a plan; spans need offsets, which Spark has no generator for, so `finder_spans` is an
Arrow function that yields a row for each match. A finder that fails yields an error row, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import areas, dates, money
from claimloom.functions.names import normalise_name
from claimloom.model import mapped
from claimloom.operators.claims import parcel_key

# -- fixed values: patterns of the fields ----------------------------------------------
ANCHOR = r"(?i)\b(consideration|sale\s+price|purchase\s+price|agreed\s+price|total\s+consideration|lump\s*sum)\b"
FORWARD, BACKWARD, WORDS_WINDOW, BASIS_WINDOW = 80, 40, 200, 60
ANY_DATE = r"\b\d{1,2}\s*(?:st|nd|rd|th)?\s*(?:day\s+of\s+)?[A-Za-z]{3,9}[,\s]+\d{4}\b|\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
EXECUTION = r"(?is)(?:executed|made|entered\s*into)\s*(?:at\s*[\w\s]{0,30}?)?(?:on|this)\s*(.{0,70})"
PARCELS = {
    "cts_number": r"(?i)\bC\.?\s?T\.?\s?S\.?\s*(?:No\.?|Number)?\s*:?\s*([\d]+(?:\s*/\s*[\w]+)?)",
    "survey_number": r"(?i)\bSurvey\s*(?:No\.?|Number)\s*:?\s*([\d]+(?:\s*/\s*[\w]+)?)",
    "plot_number": r"(?i)\bPlot\s*(?:No\.?|Number)\s*:?\s*([\w\-]+)",
}
PARCEL_TYPES = {"cts_number": "CTS", "survey_number": "SURVEY", "plot_number": "PLOT"}
TEXT_IDS = {
    "maharera_number": r"(?i)\b(P\d{11,})\b",
    "registration_number": r"(?i)\b(?:Registration|Regn\.?|Doc(?:ument)?)\s*(?:No\.?|Number)\s*:?\s*([\w\-/]+)",
    "assessment_number": r"(?i)\b(?:Assessment|Property\s+Account)\s*(?:No\.?|Number)\s*:?\s*([\w\-/]+)",
    "sub_registrar": r"(?i)\bSub[\s\-]?Registrar\s*(?:of\s+Assurances)?\s*,?\s*([A-Za-z][A-Za-z\s]{2,40})",
}
PARTY = (
    r"([A-Z][A-Za-z.\s]{2,60}?)\s*,?\s*(?i:here(?:in)?after)\s*(?i:referred\s*to\s*as|called)\s*(?i:the\s*)?"
    r"[\"'“]?((?i:VENDOR|VENDEE|PURCHASER|SELLER|BUYER|PROMOTER|ALLOTTEE|MORTGAGOR|MORTGAGEE|LESSOR|LESSEE|TRANSFEROR|TRANSFEREE))"
)
NAME_STOPWORDS = ("and", "of", "the", "one", "other", "part", "parts", "between", "party", "parties", "this", "deed", "made", "by", "&", "witnesseth", "whereas")
SELLER_ROLES = ("vendor", "seller", "transferor", "promoter", "mortgagor", "lessor")
BUYER_ROLES = ("vendee", "purchaser", "buyer", "allottee", "transferee", "mortgagee", "lessee")
GLUED = r"^(?:BETWEEN|AND)(?=[A-Z][a-z])"

#: Finder -> its pattern and the group that is the value.
PATTERNS: dict[str, tuple[str, int]] = {
    "consideration": (money.MONEY, 0),
    "dates": (ANY_DATE, 0),
    "execution_date": (EXECUTION, 1),
    "area": (areas.AREA, 0),
    **{k: (v, 1) for k, v in PARCELS.items()},
    **{k: (v, 1) for k, v in TEXT_IDS.items()},
    "parties": (PARTY, 1),
}
SPAN_SCHEMA = "finder string, raw string, value string, context string, role string, start int, end int, error string"


def _pattern(java: str) -> re.Pattern:
    flags = re.IGNORECASE if java.startswith(("(?i)", "(?is)")) else 0
    flags |= re.DOTALL if java.startswith("(?is)") else 0
    return re.compile(re.sub(r"^\(\?is?\)", "", java), flags)


def finder_spans(pages: DataFrame, finders: tuple[str, ...] = tuple(PATTERNS), keys: tuple[str, ...] = ("case_id", "document_id", "page"), text: str = "text") -> DataFrame:
    """keys and a row for each match: raw (as on the page), value, context (what the value is read from), role, start, end."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def found(finder: str, compiled: re.Pattern, group: int, page: str) -> Iterator[tuple]:
        for m in compiled.finditer(page):
            value, context, role = m[group], m[group], None
            start, end = m.span(group if finder in TEXT_IDS or finder == "parties" else 0)
            if finder == "consideration":
                context = page[m.start() : m.end() + WORDS_WINDOW]
            elif finder == "area":
                line = page.rfind("\n", 0, m.start()) + 1
                context = page[max(line, m.start() - BASIS_WINDOW) : m.end()]
            elif finder == "parties":
                role = m[2].lower()
            elif finder == "execution_date":
                # the date itself, not the phrase that announces it
                if not (value := dates.date_text(m[1])):
                    continue
                start = m.start(1) + m[1].find(value)
                yield (finder, value, value, value, None, start, start + len(value), None)
                continue
            yield (finder, m[0].strip() if finder not in TEXT_IDS and finder != "parties" else value.strip(), value, context, role, start, end, None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {f: (_pattern(PATTERNS[f][0]), PATTERNS[f][1]) for f in finders}
        for batch in batches:
            rows, own = [], []
            for i, page in enumerate(batch.column(n).to_pylist()):
                for finder, (pattern, group) in compiled.items():
                    try:
                        got = list(found(finder, pattern, group, page or ""))
                    except Exception as e:  # one field's failure stays with that field and page
                        got = [(finder, None, None, None, None, None, None, str(e))]
                    rows += got
                    own += [i] * len(got)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()]
            held = [batch.column(j).take(pa.array(own, pa.int64())) for j in range(n)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, "finder", "raw", "value", "context", "role", "start", "end", "error"])

    return pages.select(*keys, text).mapInArrow(of, f"{kinds}, {SPAN_SCHEMA}")


def trimmed_party(raw: Column) -> Column:
    """A party's name without honorific, glued connective and leading recital words."""
    tokens = F.split(F.regexp_replace(normalise_name(raw), GLUED, ""), r"\s+")
    plain = lambda t: F.regexp_replace(F.lower(t), r"^[.,]+|[.,]+$", "")
    # places of tokens that are no stopword; the name begins at the first
    keep = F.array_position(F.transform(tokens, lambda t: ~plain(t).isin(*NAME_STOPWORDS)), F.lit(True)).cast("int")
    name = F.array_join(F.slice(tokens, F.greatest(keep, F.lit(1)), F.when(keep > 0, F.size(tokens)).otherwise(0)), " ")
    return F.regexp_replace(name, r"^[ ,.]+|[ ,.]+$", "")


def valued(spans: DataFrame) -> DataFrame:
    """spans with kind, cmp_key, display, paise, sq_m, basis, date_value, notes and note, the gravest; matches without a value go."""
    amount = money.money_figures(F.col("value"))
    check = money.cross_check(F.col("context"))
    area = areas.parse_area(F.col("value"))
    basis = areas.parse_area(F.col("context"))["basis"]
    when = dates.parse_date(F.col("value"))
    party = trimmed_party(F.col("value"))
    ident = F.regexp_replace(F.col("value"), r"^[ .,;:]+|[ .,;:]+$", "")
    is_ = lambda *names: F.col("finder").isin(*names)
    parcel = is_(*PARCELS)
    kind = F.when(is_("consideration"), "money").when(is_("dates", "execution_date"), "date").when(is_("area"), "area").when(parcel, "parcel").otherwise("text")
    key = (
        F.when(is_("consideration"), amount["paise"].cast("string"))
        .when(is_("dates", "execution_date"), when["value"].cast("string"))
        .when(is_("area"), area["sq_m"].cast("string"))
        .when(parcel, parcel_key(mapped(F.col("finder"), PARCEL_TYPES), ident, F.lit(None).cast("string")))
        .when(is_("parties"), F.when(F.length(party) >= 3, F.lower(party)))
        .otherwise(F.when(ident != "", F.lower(F.regexp_replace(ident, " ", ""))))
    )
    notes = F.array_compact(
        F.array(
            F.when(is_("consideration") & (check["agree"] == False), "figures and words differ"),  # noqa: E712
            F.when(is_("consideration") & amount["suspicious"], "irregular grouping"),
            F.when(is_("consideration") & check["agree"], "figures and words agree"),
            F.when(is_("dates", "execution_date") & when["ambiguous"], "ambiguous date"),
            F.when(is_("area") & (basis == "unspecified"), "basis not stated"),
            F.when(is_("parties"), F.concat(F.lit("role="), F.col("role"))),
        )
    )
    out = spans.where("error is null").withColumns(
        {
            "kind": kind,
            "cmp_key": key,
            "display": F.when(is_("parties"), party).when(is_("consideration", "dates", "execution_date", "area"), F.col("raw")).otherwise(ident),
            "paise": F.when(is_("consideration"), amount["paise"]),
            "sq_m": F.when(is_("area"), area["sq_m"]),
            "basis": F.when(is_("area"), basis),
            "date_value": F.when(is_("dates", "execution_date"), when["value"]),
            "notes": notes,
        }
    ).withColumns(
        {
            "note": F.get("notes", F.lit(0)),
        }
    )
    return out.where("cmp_key is not null")


def nearest_anchor(anchors: DataFrame, values: DataFrame, keys: list[str], forward: int, backward: int) -> DataFrame:
    """For each anchor (keys, a_start, a_end) the nearest value (keys, start, end, ...) that begins within `forward` after it,
    else the nearest that ends within `backward` before it; anchors without either go.

    A range join on equal keys, then the best of each anchor.
    """
    ahead = F.col("start") - F.col("a_end")
    behind = F.col("a_start") - F.col("end")
    met = anchors.join(values, keys).where(((ahead >= 0) & (ahead <= forward)) | ((behind >= 0) & (behind <= backward)))
    gap = F.when(ahead >= 0, F.struct(F.lit(0), ahead)).otherwise(F.struct(F.lit(1), behind))
    best = Window.partitionBy(*keys, "a_start").orderBy(gap, "start")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def anchored_amounts(pages: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("case_id", "document_id", "page")) -> DataFrame:
    """Spans of amounts that consideration wording claims; an amount that several anchors claim counts once."""
    anchors = finder_anchor_spans(pages, keys)
    amounts = spans.where("finder = 'consideration' and error is null")
    chosen = nearest_anchor(anchors, amounts, list(keys), FORWARD, BACKWARD).select(*spans.columns)
    return chosen.dropDuplicates([*keys, "start"]).withColumn("finder", F.lit("consideration"))


def finder_anchor_spans(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """a_start and a_end of every consideration anchor."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pattern(ANCHOR)
        for batch in batches:
            found = [(i, *m.span()) for i, page in enumerate(batch.column(n).to_pylist()) for m in pattern.finditer(page or "")]
            own = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in range(n)), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())], [*keys, "a_start", "a_end"])

    return pages.select(*keys, "text").mapInArrow(of, f"{kinds}, a_start int, a_end int")
