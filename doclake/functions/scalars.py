"""Column expressions, applied table-wide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section names in the order in which they are tried (fixed values).
SECTIONS = ("abstract", "introduction", "conclusion", "methodology", "references", "results", "discussion")
#: White space as Python's str.strip sees it.
_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Code points of a text that each kind of prompt reads (fixed values).
LIMITS = {"summary": 12000, "notes": 12000, "compare": 8000, "questions": 8000, "concepts": 6000}


def detect_section(question: Column, keywords: tuple[str, ...] = SECTIONS) -> Column:
    """First keyword, in the given order, that the lower-cased question contains; else null."""
    low = F.lower(question)
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords))


def confidence(distance: Column) -> Column:
    """A distance from 0 to 2 as a percentage, one decimal."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2)) * 100, 1)


def clean_source(source: Column) -> Column:
    """Last component of a path; null is Unknown."""
    return F.coalesce(F.regexp_extract(F.rtrim(source, F.lit("/")), "[^/]+$", 0), F.lit("Unknown"))


def display_page(page: Column) -> Column:
    return page + 1


def pystrip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def snippet(content: Column, n: int = 200) -> Column:
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("…"))).otherwise(content)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters of more than three letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) > 3)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def strip_fences(raw: Column) -> Column:
    """A model's answer without code fences around it (the pattern is a fixed value)."""
    return pystrip(F.regexp_replace(pystrip(raw), r"(?md)^```(?:json)?|```$", ""))


def join_parts(content: Column) -> Column:
    """Text of an answer that came in parts (structs with ``text``)."""
    return pystrip(F.array_join(F.transform(content, lambda p: F.coalesce(p["text"], F.lit(""))), " "))


def utc_iso(ts: Column) -> Column:
    """ISO-8601 text of a timestamp in UTC, whatever the session's time zone is."""
    micros = F.unix_micros(ts)
    part = F.pmod(micros, F.lit(1_000_000))
    seconds = ((micros - part) / 1_000_000).cast("decimal(18,6)")  # exact below 2**53 microseconds
    wall = (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("string")
    return F.concat(F.replace(wall, F.lit(" "), F.lit("T")), F.lit("."), F.lpad(part.cast("string"), 6, "0"), F.lit("+00:00"))


def cap_questions(questions: Column, count: int = 5) -> Column:
    return F.slice(F.transform(questions, lambda q: q.cast("string")), 1, count)
