"""Links, file names, styles and keyword tests found in web pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relgraph.functions.roster import or_blank, present

# Patterns and keyword lists that decide the results.
DETAIL_CALL = r"memberDetail\('([^']+)'\)"
CSS_URL = r"""url\(['"]?([^'")]+)['"]?\)"""
ICON_WORDS = ["facebook", "youtube", "twitter", "instagram", "blog", "ico-", "logo"]
IMAGE_ENDINGS = [".jpg", ".jpeg", ".png", ".gif"]
PHOTO_CLASS_WORDS = ["photo", "profile", "member", "picture"]
PHOTO_ALT_WORDS = ["프로필", "사진", "의원"]
PHOTO_PATH_WORDS = ["profile", "member", "photo", "picture", "portrait"]
DATA_KEY_WORDS = ["image", "photo", "picture"]
SCRIPT_WORDS = ["image", "photo", "picture", ".jpg", ".png", ".gif"]
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the lower-cased text holds one of the words."""
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(False))


def is_picture_path(path: Column) -> Column:
    """True for image paths that are not icons or logos."""
    return ~contains_any(path, ICON_WORDS)


def file_ending(url: Column, default: str = ".jpg") -> Column:
    # the general pattern takes any text, so blanks and bad escapes keep their ending
    path = F.regexp_extract(or_blank(url), URL_PARTS, 3)
    ending = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)
    return F.when(present(ending), ending).otherwise(F.lit(default))


def media_filename(name: Column, url: Column, strict: bool = False) -> Column:
    """File name for a person's picture; ``strict`` drops special characters first."""
    base = name
    if strict:
        base = F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    named = F.concat(F.replace(base, F.lit(" "), F.lit("_")), file_ending(url))
    return F.when(present(url), named).otherwise(F.lit(""))


def link_from_onclick(onclick: Column, prefix: str) -> Column:
    """Detail link from a script call; ``''`` when there is no call."""
    code = F.regexp_extract(or_blank(onclick), DETAIL_CALL, 1)
    return F.when(code != "", F.concat(F.lit(prefix), code)).otherwise(F.lit(""))


def link_from_anchor(href: Column, onclick: Column, base: Column, prefix: str) -> Column:
    """Prefers a real ``href``, made absolute, over the script call."""
    return F.when(present(href), absolute_url(base, href)).otherwise(
        link_from_onclick(onclick, prefix)
    )


def css_image(style: Column) -> Column:
    """URL of a background image in a style text, ``''`` when absent."""
    flat = F.regexp_replace(or_blank(style), r"\s+", " ")
    return F.trim(F.regexp_extract(flat, CSS_URL, 1))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal text."""
    without = F.replace(text, F.lit(literal), F.lit(""))
    return ((F.char_length(text) - F.char_length(without)) / len(literal)).cast("long")


def absolute_url(base: Column, ref: Column) -> Column:
    """``ref`` seen from ``base``; an empty ``ref`` gives ``''``.

    Splits both with the general URL pattern and resolves ``.`` and ``..`` steps
    with an array fold, so no Python worker is involved.
    """

    def part(url: Column, group: int) -> Column:
        return F.regexp_extract(url, URL_PARTS, group)

    scheme, host, path, query = (part(base, g) for g in (1, 2, 3, 4))
    r_scheme, r_host, r_path = (part(ref, g) for g in (1, 2, 3))
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    # empty steps are dropped from a joined path but stay in a rooted one
    joined = F.regexp_replace(F.concat(F.lit("/"), folder, r_path), "/{2,}", "/")
    target = F.when(r_path.startswith("/"), r_path).otherwise(joined)
    root = F.concat(scheme, F.lit("://"), host)
    # a reference without a path keeps the base path, and the base query unless it brings its own
    same_page = F.concat(
        root,
        path,
        F.when(~tail.startswith("?") & (query != ""), F.concat(F.lit("?"), query)).otherwise(""),
        tail,
    )
    return (
        F.when(~present(ref), F.lit(""))
        .when(r_scheme != "", ref)
        .when(r_host != "", F.concat(scheme, F.lit(":"), ref))
        .when(r_path == "", same_page)
        .otherwise(F.concat(root, _without_dot_steps(target), tail))
    )


def _without_dot_steps(path: Column) -> Column:
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)

    def walk(kept: Column, step: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(step == "..", up)
            .when(step == ".", kept)
            .otherwise(F.concat(kept, F.array(step)))
        )

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(closed, "/")
    # a step up from the root may take the leading slash away
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
