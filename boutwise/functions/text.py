"""Text, id and type clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header categories and the tour each belongs to, in order of precedence.
HEADER_TOURS = [
    ("ATP - SINGLES", "atp"),
    ("WTA - SINGLES", "wta"),
    ("CHALLENGER MEN - SINGLES", "atp"),
    ("CHALLENGER WOMEN - SINGLES", "wta"),
    ("ITF MEN - SINGLES", "atp"),
    ("ITF WOMEN - SINGLES", "wta"),
]
# Surfaces recognised in a header, and the four top events.
HEADER_SURFACES = ["Hard", "Clay", "Grass", "Carpet"]
TOP_EVENTS = ["WIMBLEDON", "ROLAND GARROS", "AUSTRALIAN OPEN", "US OPEN"]
# Text that means true.
TRUE_WORDS = ["1", "true", "yes", "y"]


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty text and the word "nan" are missing values."""
    text = F.trim(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def normalize_name(c: Column, punctuation: str = ".-") -> Column:
    """Lower case, punctuation to blanks, runs of blanks to one."""
    spaced = F.translate(F.lower(c), punctuation, " " * len(punctuation))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


WIDE_PUNCTUATION = ".'-_/"


def canonical_id(c: Column) -> Column:
    """ "123.0" becomes "123"; text that is no number is kept; blank becomes NULL."""
    text = blank_to_null(c)
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def joined_key(*parts: Column) -> Column:
    """Parts joined by a bar, with NA for a missing part."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def as_double(c: Column) -> Column:
    """A finite number; NULL for text that is none, for NaN and for infinities."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def as_long(c: Column) -> Column:
    return as_double(c).try_cast("bigint")


def as_flag(c: Column) -> Column:
    """1 for the words that mean true, else 0, also for a missing value."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUE_WORDS).cast("int"), F.lit(0))


def first_present(df: DataFrame, names: list[str], kind: str) -> Column:
    """The first of the named columns that the table has, cast to `kind`; NULL if it has none."""
    for name in names:
        if name in df.columns:
            return F.col(name).try_cast(kind)
    return F.lit(None).cast(kind)


def parse_date8(c: Column) -> Column:
    """YYYYMMDD as a date; NULL when it is no such date."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def map_code(c: Column, labels: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[c], default)


def parse_header(c: Column) -> dict[str, Column]:
    """Tour, tournament, surface and level out of "Name (CTY), surface ⏎ CATEGORY - SINGLES"."""
    parts = F.filter(F.transform(F.split(c, r"[|\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    left, category = F.get(parts, F.lit(0)), F.upper(F.get(parts, F.lit(1)))
    tour = F.coalesce(*[F.when(category.contains(text), F.lit(t)) for text, t in HEADER_TOURS])
    tail = F.initcap(F.trim(F.element_at(F.split(left, ","), -1)))
    surface = F.when(left.contains(","), F.coalesce(
        *[F.when(tail.contains(name), F.lit(name)) for name in HEADER_SURFACES], tail))
    level = (
        F.when(F.upper(left).rlike("|".join(TOP_EVENTS)), "G")
        .when(category.contains("CHALLENGER") | category.contains("ITF"), "C").otherwise("A")
    )
    known = tour.isNotNull()
    return {
        "tour": tour, "tournament": F.when(known, left),
        "surface": F.when(known, surface), "level": F.when(known, level),
    }


def event_id(url: Column, row_id: Column) -> Column:
    """The `mid` parameter of the URL, else what follows the last underscore of the row id."""
    mid = F.trim(F.regexp_extract(url, r"[?&]mid=([^&#]*)", 1))
    return F.coalesce(F.when(mid != "", mid), F.trim(F.substring_index(row_id, "_", -1)))


def event_time(c: Column, year: Column) -> dict[str, Column]:
    """Date and time out of "dd.mm. HH:MM" and the year the page is for."""
    parts = F.split(F.trim(c), r"\s+")
    day = F.get(parts, F.lit(0))
    date = F.when(
        day.rlike(r"^\d{1,2}\.\d{1,2}\.$"),
        F.try_to_timestamp(F.concat(day, year.cast("string")), F.lit("d.M.yyyy")).cast("date"))
    clock = F.get(parts, F.lit(1))
    return {"match_date": date, "match_time": F.when(clock.contains(":"), clock)}
