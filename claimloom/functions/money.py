"""Amounts: digit grouping, figures, words, and whether they agree. Amounts are integer paise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# -- fixed values -----------------------------------------------------------------------
INDIAN_GROUPS = r"^\d{1,2}(,\d{2})*,\d{3}$"
WESTERN_GROUPS = r"^\d{1,3}(,\d{3})*$"
MONEY = r"(?i)(?:Rs\.?|INR|₹|Rupees)\s*([\d,]+(?:\.\d{1,2})?)\s*/?-?"
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}
SCALES = {
    "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000,
    "lacs": 100_000, "thousand": 1_000, "thousands": 1_000, "hundred": 100, "hundreds": 100,
}
SCALE_WORD = r"(?i)\b(crore|lakh|lac|thousand|hundred)\b"
LARGE_WORD = r"(?i)\b(crore|lakh|lac)\b"


def grouping(figure: Column) -> Column:
    """ungrouped, indian, western or irregular, by the digits before the point."""
    whole = F.substring_index(F.trim(figure), ".", 1)
    return (
        F.when(~F.contains(whole, F.lit(",")), "ungrouped").when(whole.rlike(INDIAN_GROUPS), "indian").when(whole.rlike(WESTERN_GROUPS), "western").otherwise("irregular")
    )


def figure_paise(figure: Column) -> Column:
    """Paise of a figure such as 1,25,000.50; null if it is none."""
    rupees = F.regexp_replace(figure, ",", "").try_cast("decimal(20,2)")
    return F.bround(rupees * 100, 0).cast("long")


def money_figures(text: Column) -> Column:
    """The first amount in figures: raw, paise, grouping, suspicious; null if there is none."""
    figure = F.regexp_extract(text, MONEY, 1)
    parts = F.struct(F.trim(F.regexp_extract(text, MONEY, 0)).alias("raw"), figure_paise(figure).alias("paise"), grouping(figure).alias("grouping"))
    return let(parts, lambda p: F.when((p["raw"] != "") & p["paise"].isNotNull(), F.struct(p["raw"].alias("raw"), p["paise"].alias("paise"), p["grouping"].alias("grouping"), (p["grouping"] == "irregular").alias("suspicious"))))


def _number(word: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), word)


def words_rupees(text: Column) -> Column:
    """Rupees of an amount in words with Indian scales; null if no number word occurs. Other words are passed over."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z\s]", " "), r"\s+")
    # one lookup for each word: scales stand as negative numbers
    table = UNITS | {w: -n for w, n in SCALES.items()}
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("current"), F.lit(False).alias("seen"))

    def step(state: Column, word: Column) -> Column:
        return let(_number(word, table), lambda n: F.when(n.isNull(), state).otherwise(counted(state, n)))

    def counted(state: Column, n: Column) -> Column:
        held = F.when(state["current"] == 0, F.lit(1).cast("long")).otherwise(state["current"])
        total = F.when(n <= -1000, state["total"] - held * n).otherwise(state["total"])
        current = F.when(n >= 0, state["current"] + n).when(n <= -1000, zero).otherwise(-held * n)
        return F.struct(total.alias("total"), current.alias("current"), F.lit(True).alias("seen"))

    return F.aggregate(words, start, step, lambda s: F.when(s["seen"], s["total"] + s["current"]))


def cross_check(text: Column) -> Column:
    """figures_paise, words_rupees and agree (null where one of them is missing).

    Words in parentheses count first, where they hold a scale word; else the whole text, where it holds a large one.
    """
    inside = F.filter(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda c: c.rlike(SCALE_WORD))
    parsed = F.filter(F.transform(inside, words_rupees), lambda v: v > 0)
    words = F.coalesce(F.get(parsed, F.lit(0)), F.when(text.rlike(LARGE_WORD), words_rupees(text)))
    both = F.struct(money_figures(text)["paise"].alias("figures"), words.alias("words"))
    return let(both, lambda b: F.struct(b["figures"].alias("figures_paise"), b["words"].alias("words_rupees"), (b["figures"] == b["words"] * 100).alias("agree")))


def format_indian(rupees: Column) -> Column:
    """A whole number with Indian digit groups: the last three digits, then pairs."""
    digits = F.abs(rupees).cast("string")
    head, tail = F.left(digits, F.greatest(F.length(digits) - 3, F.lit(0))), F.right(digits, F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.concat(F.when(rupees < 0, "-").otherwise(""), F.when(head == "", tail).otherwise(F.concat_ws(",", grouped, tail)))


def in_words(rupees: Column) -> Column:
    """A whole number below 10^9 in words with Indian scales: the inverse of words_rupees."""
    small = {v: k for k, v in reversed(UNITS.items())}
    names = F.create_map(*(F.lit(x) for pair in small.items() for x in pair))

    def below_hundred(n: Column) -> Column:
        tens, ones = (n - n % 10).cast("int"), (n % 10).cast("int")
        return F.when(n == 0, "").when(n <= 20, F.try_element_at(names, n.cast("int"))).otherwise(F.concat_ws(" ", F.try_element_at(names, tens), F.when(ones > 0, F.try_element_at(names, ones))))

    parts = []
    for size, base, word in ((100, 10_000_000, "crore"), (100, 100_000, "lakh"), (100, 1_000, "thousand"), (10, 100, "hundred")):
        n = F.floor(rupees / base) % size
        parts.append(F.when(n > 0, F.concat_ws(" ", below_hundred(n), F.lit(word))))
    rest = rupees % 100
    parts.append(F.when(rest > 0, below_hundred(rest)))
    return F.when(rupees == 0, "zero").otherwise(F.concat_ws(" ", *parts))
