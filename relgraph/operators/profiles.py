"""Member records out of list, card and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from relgraph.functions import roster, web
from relgraph.functions.roster import or_blank, present
from relgraph.operators.pages import (
    DOCUMENT,
    STRINGS,
    around,
    at,
    attr,
    below,
    directly,
    each_around,
    innermost,
    inside,
    outermost,
    own,
    step,
    with_text,
)
from relgraph.session import cut

# Places, labels and defaults that decide the results.
LIST_BODY = step(ident="list-result-sect")
NAME_ANCHOR = step("a", cls="hgNm")
CARD = directly(step(cls="nassem_result_ul"), step("li"), step("a", cls="nassem_reslut_pic"))
DEFAULT_UNIT = "제22대"
CAREER = "약력"
LIST_CELLS = [
    "number", "daesu", "name", "party", "committee", "region", "gender", "election_count", "election_method",
]
INTRO_LABELS = [
    ("선거구", "region", "선거구"),
    ("소속위원회", "committee", "소속위원회"),
    ("당선횟수", "election_count", "당선횟수"),
    ("전화", "phone", "사무실 전화"),
]
SPAN_PARTIES = "국민의힘|더불어민주당|정의당"
PICTURE = r"(?i)\.(jpg|jpeg|png|gif)"

LIST_TAGS = {"table", "tbody", "tr", "td", "th", "a", "#list-result-sect"}
CARD_TAGS = {"a", "img", "span", "i", "div", "li", ".nassem_result_ul"}
DETAIL_TAGS = {DOCUMENT, "div", "section", "span", "h1", "ul", "li", "strong", "img", "dt", "dd"}


def member_list(
    elements: DataFrame,
    prefix: str,
    base: Column | None = None,
    by_anchor: bool = False,
    key: str = "page_id",
    place: str = "either",
) -> DataFrame:
    """Rows of at least nine cells of the member table, cell by position.

    ``place`` says where: "section" reads below ``#list-result-sect``, "table" the first
    table (its body, or all rows but the first), "either" the table of pages without the
    section. ``by_anchor`` takes the name from
    the name anchor instead of the third cell. With ``base`` a real link is
    preferred over the script call.
    """
    named = F.col("tag").isin("table", "tbody", "tr", "td", "th", "a", STRINGS)
    # one shuffle by page serves all windows and the grouping
    parts = with_text(elements.where(named | own(LIST_BODY)), F.col("tag").isin("td", "a"), key, others=True)
    parts = below(below(parts, LIST_BODY, "listed", key), step("tbody"), "in_body", key)
    parts = outermost(outermost(parts, step("table"), "table_seq", key), step("td"), "cell", key)
    parts = innermost(parts, step("tr"), "row_seq", key)
    rows = (
        parts.where(F.col("tag").isin("td", "th", "a") & F.col("row_seq").isNotNull())
        .select(
            key,
            "row_seq",
            "listed",
            "table_seq",
            "in_body",
            F.struct(
                "seq",
                "tag",
                "text",
                attr("href").alias("href"),
                attr("onclick").alias("onclick"),
                own(NAME_ANCHOR).alias("is_name"),
                "cell",
            ).alias("part"),
        )
        .groupBy(key, "row_seq")
        .agg(
            F.max("listed").alias("listed"),
            F.min("table_seq").alias("table_seq"),
            F.max("in_body").alias("in_body"),
            F.array_sort(F.collect_list("part")).alias("parts"),
        )
    )
    page = Window.partitionBy(key)
    rows = (
        rows.withColumn("page_listed", F.max("listed").over(page))
        .withColumn("first_table", F.min("table_seq").over(page))
        .withColumn("first_row", F.min("row_seq").over(Window.partitionBy(key, "table_seq")))
        .withColumn("has_body", F.max("in_body").over(Window.partitionBy(key, "table_seq")))
    )
    unlisted = (F.col("table_seq") == F.col("first_table")) & F.when(
        F.col("has_body"), F.col("in_body")
    ).otherwise(F.col("row_seq") > F.col("first_row"))
    places = {
        "section": F.col("listed"),
        "table": unlisted,
        "either": F.when(F.col("page_listed"), F.col("listed")).otherwise(unlisted),
    }
    cells = F.filter("parts", lambda p: p["tag"] == "td")
    full = (
        rows.where(places[place])
        .withColumn("cells", cells)
        .where(F.size("cells") >= len(LIST_CELLS))
        .withColumn(
            "anchor",
            F.try_element_at(
                F.filter(
                    "parts", lambda p: (p["tag"] == "a") & (p["cell"] == F.col("cells")[2]["seq"])
                ),
                F.lit(1),
            ),
        )
        .withColumn(
            "name_anchor",
            F.try_element_at(
                F.filter("parts", lambda p: p["is_name"] & (p["cell"] == F.col("cells")[2]["seq"])),
                F.lit(1),
            ),
        )
    )
    onclick = F.col("anchor.onclick")
    link = (
        web.link_from_onclick(onclick, prefix)
        if base is None
        else web.link_from_anchor(F.col("anchor.href"), onclick, base, prefix)
    )
    texts = {c: F.col("cells")[i]["text"] for i, c in enumerate(LIST_CELLS)}
    if by_anchor:
        texts["name"] = or_blank(F.col("name_anchor.text"))
    return full.select(
        key, F.col("row_seq").alias("seq"), *[v.alias(c) for c, v in texts.items()], link.alias("detail_link")
    )


def photo_cards(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """``(page, index, name, party, photo_url, photo_filename)`` of each card, 0-based index."""
    mine = F.col("tag").isin("a", "img", "span", "i", "div", "li", STRINGS) | own(step(cls="nassem_result_ul"))
    parts = with_text(elements.where(mine), F.col("tag").isin("span", "i"), key, others=True)
    parts = around(at(parts, CARD, "is_card", key), "is_card", "in_card", key)
    parts = outermost(parts, step("a", cls="nassem_reslut_pic"), "anchor", key)
    parts = at(parts, directly(step("div"), step("img")), "is_photo", key, above="is_card")
    parts = around(at(parts, step("span"), "is_span", key, above="is_card"), "is_span", "in_span", key)
    # the card itself opens its group; its parts follow
    card = F.when(F.col("is_card"), F.col("seq")).when(F.col("in_card"), F.col("anchor"))
    owned = parts.withColumn("card", card).where(F.col("card").isNotNull())

    def first(value: Column, test: Column) -> Column:
        return or_blank(F.min_by(F.when(test, value), F.when(test, F.col("seq"))))

    cards = owned.groupBy(key, "card").agg(
        first(attr("src"), F.col("is_photo")).alias("photo_url"),
        F.min_by(
            F.when(F.col("tag") == "span", F.struct("seq", "text")),
            F.when(F.col("tag") == "span", F.col("seq")),
        ).alias("span"),
        first(F.col("text"), (F.col("tag") == "i") & F.col("in_span")).alias("party"),
    )
    text = or_blank(F.col("span.text"))
    name = F.trim(F.when(F.col("party") == "", text).otherwise(F.replace(text, F.col("party"), F.lit(""))))
    order = Window.partitionBy(key).orderBy("card")
    return cards.select(
        key,
        (F.row_number().over(order) - 1).alias("index"),
        name.alias("name"),
        "party",
        "photo_url",
        web.media_filename(name, F.col("photo_url")).alias("photo_filename"),
    )


def cards_with_list(cards: DataFrame, listed: DataFrame, page: Column, unit_code: str, key: str = "page_id") -> DataFrame:
    """Cards joined to the first list row of the same page and name, with defaults."""
    rest = [c for c in LIST_CELLS if c not in ("name", "party")]
    row = F.struct(*rest)
    first = listed.groupBy(key, "name").agg(F.min_by(row, F.col("seq")).alias("row"))
    return cards.join(first, [key, "name"], "left").select(
        key,
        "index",
        "name",
        "party",
        "photo_url",
        "photo_filename",
        roster.card_number(page, F.col("index")).alias("monaCd"),
        F.lit(unit_code).alias("unitCd"),
        or_blank(F.col("row.number")).alias("rownum"),
        F.coalesce("row.daesu", F.lit(DEFAULT_UNIT)).alias("unit"),
        or_blank(F.col("row.committee")).alias("committees"),
        *[or_blank(F.col(f"row.{c}")).alias(c) for c in ("region", "gender", "election_count", "election_method")],
    )


def first_records(members: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """The first ``n`` records in page and index order."""
    return members.orderBy(key, "index").limit(n)


def pages_before_gap(rows: DataFrame, pages: DataFrame, last: int, key: str = "page_id") -> DataFrame:
    """Rows of the pages up to ``last`` and before the first page without rows."""
    empty = pages.select(key).join(rows.select(key).distinct(), key, "left_anti")
    gap = empty.agg(F.min(key)).first()[0]
    stop = last + 1 if gap is None else min(gap, last + 1)
    return rows.where(F.col(key) < stop)


def detail_profiles(elements: DataFrame, base: Column, name: Column | None = None, key: str = "page_id") -> DataFrame:
    """One row per detail page: ``detailed_party, photo_url, extra map, 약력 array``.

    ``extra`` holds each ``<li><strong>key</strong>value</li>`` of the profile and
    contact lists; contact lists and later items win. Absent parts are null.
    ``base`` is the address of the page, as a column over ``page_id``.
    """
    profile, contact = step("div", cls="profile_area"), step("div", cls="contact_area")
    career, photo = step("div", cls="career_area"), step("div", cls="photo_area")
    marked = elements.where(F.col("tag").isin("div", "ul", "li", "strong", "span", "img", STRINGS))
    marked = below(below(marked, inside(profile, step("ul", cls="profile_list")), "in_profile", key), contact, "in_contact", key)
    marked = below(below(marked, inside(career, step("ul")), "in_career", key), photo, "in_photo", key)
    marked = at(marked, inside(profile, step("span", cls="party")), "is_party", key)
    marked = outermost(outermost(marked, profile, "profile", key), contact, "contact", key)
    marked = outermost(marked, step("ul"), "list", key)
    marked = marked.withColumn("area", F.when(F.col("in_profile"), 1).when(F.col("in_contact"), 2))
    is_item = F.col("tag").isin("li", "strong") & (F.col("area").isNotNull() | F.col("in_career"))
    wanted = is_item | F.col("is_party") | ((F.col("tag") == "img") & F.col("in_photo"))
    # three branches read the parts; the pages are parsed once
    elements = cut(with_text(marked, wanted, key), "elements")

    # strong elements are brought to their list items, where key and value meet
    parts = elements.where(F.col("tag").isin("li", "strong") & F.col("area").isNotNull())
    items = parts.where(F.col("tag") == "li").withColumn("item", F.col("seq"))
    names = each_around(parts, step("li"), "item", key).where(F.col("tag") == "strong")
    parts = items.unionByName(names).withColumn("section", F.coalesce("profile", "contact"))
    first_section = F.min("section").over(Window.partitionBy(key, "area"))
    items = (
        parts.withColumn("first_section", first_section)
        .where(F.col("section") == F.col("first_section"))
        .groupBy(key, "area", "item")
        .agg(
            F.max(F.when(F.col("seq") == F.col("item"), F.col("text"))).alias("whole"),
            F.min_by(
                F.when(F.col("tag") == "strong", F.col("text")),
                F.when(F.col("tag") == "strong", F.col("seq")),
            ).alias("name"),
        )
        .where(F.col("name").isNotNull())
    )
    value = F.when(F.col("name") == "", F.col("whole")).otherwise(
        F.replace("whole", F.col("name"), F.lit(""))
    )
    pairs = (
        items.groupBy(key, "name")
        .agg(F.max_by(F.trim(value), F.struct("area", "item")).alias("value"))
        .select(key, F.lit("pair").alias("kind"), F.lit(0).alias("seq"), "name", "value")
    )

    def of_kind(test: Column, kind: str, text: Column = F.col("text")) -> DataFrame:
        return elements.where(test).select(
            key, F.lit(kind).alias("kind"), "seq", F.lit("").alias("name"), text.alias("value")
        )

    careers = (
        elements.where((F.col("tag") == "li") & F.col("in_career"))
        .withColumn("first_list", F.min("list").over(Window.partitionBy(key)))
        .where(F.col("list") == F.col("first_list"))
        .select(key, F.lit("career").alias("kind"), "seq", F.lit("").alias("name"), F.col("text").alias("value"))
    )
    facts = (
        pairs.unionByName(careers)
        .unionByName(of_kind(F.col("is_party"), "party"))
        .unionByName(of_kind((F.col("tag") == "img") & F.col("in_photo"), "photo", attr("src")))
    )

    def first(kind: str) -> Column:
        hit = F.col("kind") == kind
        return F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("seq")))

    def listed(kind: str, fields: list[str]) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*fields))))

    grouped = facts.groupBy(key).agg(
        first("party").alias("detailed_party"),
        first("photo").alias("src"),
        F.map_from_entries(listed("pair", ["name", "value"])).alias("extra"),
        F.transform(listed("career", ["seq", "value"]), lambda s: s["value"]).alias(CAREER),
    )
    url = F.when(present(F.col("src")), web.absolute_url(base, F.col("src")))
    rows = grouped.select(key, "detailed_party", url.alias("photo_url"), "extra", CAREER)
    if name is None:
        return rows
    return rows.withColumn("photo_filename", web.media_filename(name, F.col("photo_url"), strict=True))


def direct_profiles(elements: DataFrame, base: Column, key: str = "page_id") -> DataFrame:
    """One row per member page of the free-form kind.

    ``name, party, region, committee, election_count, phone, email, career,
    photo_url, photo_filename``; parts that are not found are null. A phone number
    or e-mail address found anywhere in the page text wins over the labelled one.
    """
    info_div, info_section = step("div", cls="profile_info"), step("section", cls="member_info")
    career_div, career_section = step("div", cls="career"), step("section", cls="career")

    def preferred(wanted: str, other: str) -> Column:
        return F.when(F.col(wanted).isNotNull(), F.struct(F.lit(0).alias("rank"), F.col(wanted).alias("at"))).when(
            F.col(other).isNotNull(), F.struct(F.lit(1).alias("rank"), F.col(other).alias("at"))
        )

    page = Window.partitionBy(key)
    placed = with_text(elements, F.col("tag").isin("h1", "span", "li", "dt", "dd"), key, others=True)
    for name, place in (("_info", info_div), ("_member", info_section), ("_career", career_div), ("_section", career_section)):
        placed = outermost(placed, place, name, key)
    seen = (
        placed.withColumn("intro", preferred("_info", "_member"))
        .withColumn("career", preferred("_career", "_section"))
        .withColumn("first_intro", F.min("intro").over(page))
        .withColumn("first_career", F.min("career").over(page))
    )
    in_intro = (F.col("intro") == F.col("first_intro")) & F.col("tag").isin("dt", "dd", "li")
    text = F.col("text")
    field = F.lit(None).cast("struct<field:string,value:string>")
    branches = [
        (F.contains(text, F.lit(label)), name, F.trim(F.replace(text, F.lit(removed), F.lit(""))))
        for label, name, removed in INTRO_LABELS
    ]
    branches.append((F.contains(text, F.lit("이메일")) | F.contains(text, F.lit("@")), "email", text))
    for test, name, value in reversed(branches):
        field = F.when(test, F.struct(F.lit(name).alias("field"), value.alias("value"))).otherwise(field)
    seen = seen.withColumn("routed", F.when(in_intro, field))

    def first(value: Column, test: Column) -> Column:
        return F.min_by(F.when(test, value), F.when(test, F.col("seq")))

    def routed(name: str) -> Column:
        hit = F.col("routed.field") == name
        return F.max_by(F.when(hit, F.col("routed.value")), F.when(hit, F.col("seq"))).alias(name)

    is_career = (F.col("career") == F.col("first_career")) & (F.col("tag") == "li") & (text != "")
    grouped = seen.groupBy(key).agg(
        first(roster.plain_name(text), F.col("tag") == "h1").alias("name"),
        first(text, (F.col("tag") == "span") & text.rlike(SPAN_PARTIES)).alias("span_party"),
        F.max(own(step("div", cls="party"))).alias("party_box"),
        F.max(F.when(F.col("tag") == DOCUMENT, text)).alias("page_text"),
        *[routed(n) for n in ("region", "committee", "election_count", "phone", "email")],
        F.array_sort(F.collect_list(F.when(is_career, F.struct("seq", "text")))).alias("career"),
        F.max(F.col("career").isNotNull()).alias("has_career"),
        first(attr("src"), (F.col("tag") == "img") & attr("src").rlike(PICTURE)).alias("src"),
    )
    phone = F.nullif(roster.phone_in(F.col("page_text")), F.lit(""))
    email = F.nullif(roster.email_in(F.col("page_text")), F.lit(""))
    # a party box without a matching span leaves the party open
    party = F.coalesce(
        "span_party", F.when(~F.col("party_box"), roster.party_in(F.col("page_text")))
    )
    url = F.when(present(F.col("src")), web.absolute_url(base, F.col("src")))
    return grouped.select(
        key,
        "name",
        party.alias("party"),
        "region",
        "committee",
        "election_count",
        F.coalesce(phone, "phone").alias("phone"),
        F.coalesce(email, "email").alias("email"),
        F.when(F.col("has_career"), F.transform("career", lambda s: s["text"])).alias("career"),
        url.alias("photo_url"),
        F.when(present(F.col("name")), web.media_filename(F.col("name"), url, strict=True)).alias("photo_filename"),
    )


def with_details(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """List records updated by detail records: a value the detail page has wins, also a blank one."""
    shared = [c for c in details.columns if c != key and c in listed.columns]
    added = [c for c in details.columns if c != key and c not in listed.columns]
    d = details.select(key, *[F.col(c).alias(f"_{c}") for c in shared], *added)
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in shared else F.col(c) for c in listed.columns]
    return listed.join(d, key, "left").select(*kept, *added)
