"""Fields of a roster record: ids, regions, terms, schools, defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts and patterns that decide the results.
PROPORTIONAL = "비례대표"
COUNT_PATTERN = r"(\d+)선"
TERM_PATTERN = r"제(\d+)대"
SCHOOL_PATTERN = "([가-힣]+대학교?)"
TITLE_PREFIX = "국회의원"
PHONE_PATTERN = r"02-\d{3,4}-\d{4}"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PARTY_PRIORITY = ["국민의힘", "더불어민주당", "정의당", "개혁신당", "국민의당"]


def present(c: Column) -> Column:
    """True when a text is neither null nor empty."""
    return c.isNotNull() & (c != F.lit(""))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def id_from_link(link: Column) -> Column:
    """Last path step of a link; a trailing slash gives ``''``."""
    return F.element_at(F.split(link, "/"), -1)


def sido_of(text: Column) -> Column:
    """First word of a two-part region text, else null."""
    parts = F.split(text, " ", 2)
    return F.when(present(text) & ~F.contains(text, F.lit(PROPORTIONAL)) & (F.size(parts) == 2), parts[0])


def district_of(text: Column) -> Column:
    """What follows the first blank; the whole text when there is none."""
    parts = F.split(text, " ", 2)
    return (
        F.when(~present(text), F.lit(None).cast("string"))
        .when(F.contains(text, F.lit(PROPORTIONAL)), F.lit(PROPORTIONAL))
        .otherwise(F.element_at(parts, -1))
    )


def election_count(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, COUNT_PATTERN, 1).try_cast("int"), F.lit(0))


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(1))
    numbers = F.filter(F.transform(found, lambda t: t.try_cast("int")), lambda t: t.isNotNull())
    return F.coalesce(numbers, F.array().cast("array<int>"))


def school_of(line: Column) -> Column:
    """First university name of a career line, else null."""
    return F.nullif(F.regexp_extract(line, SCHOOL_PATTERN, 1), F.lit(""))


def plain_name(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit(TITLE_PREFIX), F.lit("")))


def phone_in(text: Column) -> Column:
    return F.regexp_extract(text, PHONE_PATTERN, 0)


def email_in(text: Column) -> Column:
    return F.regexp_extract(text, EMAIL_PATTERN, 0)


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword of the list that occurs in the text, else null."""
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))
    return F.try_element_at(hits, F.lit(1))


def party_in(text: Column, parties: list[str] = PARTY_PRIORITY) -> Column:
    return first_keyword(text, parties)


def items(text: Column, separator: str = ",") -> Column:
    """Separated list to trimmed, non-blank items; null gives an empty array."""
    parts = F.transform(F.split(text, separator), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def joined(names: Column, separator: str = ",") -> Column:
    """Array to text, in sorted order."""
    return F.array_join(F.array_sort(names), separator)


def run_date(now: Column) -> Column:
    return F.date_format(now, "yyyyMMdd")


def date_or_today(date: Column, now: Column) -> Column:
    return F.coalesce(date, F.date_format(now, "yyyy-MM-dd"))


def first_chars(text: Column, n: int) -> Column:
    """The character window a size-limited model reads."""
    return F.substring(text, 1, n)


def windows(text: Column, size: int) -> Column:
    """All of a text in windows of ``size`` characters; one, empty or null, of an empty or null text.

    The pattern passes over the text once.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def card_number(page: Column, index: Column, per_page: int = 30) -> Column:
    """Running number of a card from its 1-based page and 0-based place, as text."""
    return ((page - 1) * per_page + index + 1).cast("string")
