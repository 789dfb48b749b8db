"""Web pages: the given ones, and member pages that Spark builds from the tables.

Member list pages hold twenty customers each and detail pages one supplier each, so
their number grows with the tables while a page keeps its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.functions import web
from relgraph.operators import pages as pg, profiles
from relgraph.operators.pages import step
from relgraph.session import cut
from relgraph.skew import TASK_ROWS, by_key, spread
from workload.base import page_text_sql, query, table

PREFIX = "https://members.example.org/22nd/"
LIST_URL = "https://members.example.org/list"
DECODE = "replace(replace({}, '&quot;', '\"'), '&amp;', '&')"


def page_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _page_elements(spark, sf_dir, *tags: str, texts: bool = True) -> DataFrame:
    return pg.html_elements(page_table(spark, sf_dir), set(tags), texts=texts)


# --- given pages -----------------------------------------------------------------------


@query(
    f"""WITH found AS (
      SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
             unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS raw FROM pages)
    SELECT page_id, {DECODE.format('href')} AS href, trim({DECODE.format('raw')}) AS text,
      regexp_extract(url, '^(https?://[^/]+)', 1) || {DECODE.format('href')} AS full_url FROM found"""
)
def page_links(spark, sf_dir):
    # the address travels in the key, so no join brings it back
    pages = page_table(spark, sf_dir).select(F.struct("page_id", "url").alias("page"), "html")
    found = pg.links(pg.html_elements(pages, {"a"}, key="page"), key="page")
    return found.select(
        "page.page_id", "href", "text", web.absolute_url(F.col("page.url"), F.col("href")).alias("full_url")
    )


@query(
    f"""SELECT page_id, 'title' AS tag, trim({DECODE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS text FROM pages
    UNION ALL
    SELECT page_id, 'h1', trim({DECODE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) FROM pages"""
)
def page_headings(spark, sf_dir):
    return pg.headings(_page_elements(spark, sf_dir, "title", "h1", "h2")).select("page_id", "tag", "text")


TAGS = ["a", "li", "p", "b", "br", "h1", "script", "table", "form", "img"]


@query(
    " UNION ALL ".join(
        f"""SELECT page_id, '{t}' AS tag,
        len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<{t}[ >]')) AS n FROM pages"""
        for t in TAGS
    )
)
def tag_inventory(spark, sf_dir):
    # every page keeps its root row, so pages without the tags count too
    return pg.tag_counts(_page_elements(spark, sf_dir, pg.DOCUMENT, *TAGS, texts=False), TAGS)


PLACES = {
    "ul li": pg.inside(step("ul"), step("li")),
    "nav > ul > li > a": pg.directly(step("nav"), step("ul"), step("li"), step("a")),
    ".ad": step(cls="ad"),
    "div[class*='a']": step("div", cls_part="a"),
    "#list-result-sect": step(ident="list-result-sect"),
}


@query(
    """WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages)
    SELECT page_id, 'ul li' AS place, len(regexp_extract_all(h, '<li>')) AS n FROM c
    UNION ALL SELECT page_id, 'nav > ul > li > a', len(regexp_extract_all(h, '<li><a ')) FROM c
    UNION ALL SELECT page_id, '.ad', len(regexp_extract_all(h, '<div class="ad">')) FROM c
    UNION ALL SELECT page_id, 'div[class*=''a'']', len(regexp_extract_all(h, '<div class="ad">')) FROM c
    UNION ALL SELECT page_id, '#list-result-sect', 0 FROM c"""
)
def place_inventory(spark, sf_dir):
    kept = _page_elements(spark, sf_dir, pg.DOCUMENT, "li", "a", "div", "ul", "nav", ".ad", "#list-result-sect", texts=False)
    return pg.place_counts(kept, PLACES)


@query(
    """WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1) AS rank FROM pages)
    SELECT page_id, 'links' AS place, rank, href FROM f WHERE rank <= 3"""
)
def first_examples(spark, sf_dir):
    """The first three elements per page and place; the small number is the report itself."""
    found = pg.first_at(
        _page_elements(spark, sf_dir, "a", "li", texts=False), {"links": pg.directly(step("li"), step("a"))}, 3
    )
    return found.select("page_id", "place", "rank", pg.attr("href").alias("href"))


@query(page_text_sql())
def page_text(spark, sf_dir):
    return spread(page_table(spark, sf_dir)).select("page_id", pg.article_text(F.col("html")).alias("text"))


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
        regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages),
    q AS (SELECT *, CASE WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = '' THEN '.jpg'
        ELSE regexp_extract(path, '(\\.[^./]*)$', 1) END AS ending, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM p)
    SELECT page_id, ending, 'page_' || page_id || ending AS filename,
      root || regexp_replace(folder, '[^/]+/$', '') || 'img/x.png' AS beside FROM q"""
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    name = F.concat(F.lit("page* "), F.col("page_id"))
    return page_table(spark, sf_dir).select(
        "page_id",
        web.file_ending(url).alias("ending"),
        web.media_filename(name, url, strict=True).alias("filename"),
        web.absolute_url(url, F.lit("../img/x.png")).alias("beside"),
    )


@query("SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS text FROM pages")
def script_inventory(spark, sf_dir):
    return pg.image_scripts(_page_elements(spark, sf_dir, "script"), ["track"]).select("page_id", "text")


@query(
    f"""SELECT page_id, 'div' AS tag, 'ad' AS classes,
      trim({DECODE.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}) AS text FROM pages"""
)
def class_texts(spark, sf_dir):
    return pg.class_texts(_page_elements(spark, sf_dir, "div", "p", "h1", "article"), ["ad"]).select(
        "page_id", "tag", "classes", "text"
    )


KEYWORDS = ["License", "Nicht", "Avec"]


@query(
    f"""WITH RECURSIVE pieces AS MATERIALIZED (
      SELECT page_id, i, parts[i] AS piece, lower(regexp_extract(parts[i], '^/?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag
      FROM (SELECT page_id, string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<') AS parts FROM pages),
        unnest(range(1, len(parts) + 1)) AS u(i)),
    walk(page_id, i, open) AS (
      SELECT page_id, 0::BIGINT, ['#document'] FROM pages
      UNION ALL SELECT p.page_id, p.i, CASE
          WHEN tag = '' OR p.i = 1 THEN open
          WHEN starts_with(piece, '/') AND list_contains(open, tag) THEN open[:len(open) - list_position(list_reverse(open), tag)]
          WHEN starts_with(piece, '/') OR tag IN ('br', 'meta', 'img', 'input', 'link', 'hr') THEN open
          ELSE list_append(open, tag) END
      FROM walk w JOIN pieces p ON p.page_id = w.page_id AND p.i = w.i + 1),
    nodes AS (SELECT page_id, open[len(open)] AS parent_tag,
        {DECODE.format("replace(replace(regexp_extract(piece, '(?s)^[^>]*>(.*)$', 1), '&copy;', '©'), '&middot;', '·')")} AS text FROM walk JOIN pieces USING (page_id, i))
    SELECT page_id, keyword, parent_tag, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
    FROM nodes JOIN (VALUES {", ".join(f"('{w}')" for w in KEYWORDS)}) AS k(keyword) ON contains(text, keyword)"""
)
def keyword_texts(spark, sf_dir):
    """Text nodes with a keyword and their parent."""
    nodes = _page_elements(spark, sf_dir, pg.TEXT, texts=False)
    return pg.keyword_texts(nodes, KEYWORDS).select("page_id", "keyword", "parent_tag", "text")


WORDS = ["License", "Nicht", "Avec", "https"]


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{w}' AS keyword, CAST(contains(text, '{w}') AS INT) AS found FROM documents" for w in WORDS
    )
)
def keyword_flags(spark, sf_dir):
    flags = pg.keyword_flags(table(spark, sf_dir, "documents"), WORDS, "doc_id")
    return flags.withColumn("found", F.col("found").cast("int"))


@query(
    """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE contains(text, 'License'))
    SELECT doc_id, (length(text) - length(replace(text, 'License', ''))) // 7 AS n, line_no, md5(line) AS line
    FROM l WHERE contains(line, 'License')"""
)
def literal_lines(spark, sf_dir):
    found = pg.literal_lines(table(spark, sf_dir, "documents"), "License", "doc_id", "text")
    return found.withColumn("line", F.md5("line"))


# --- member list pages built from customers -----------------------------------------------

MEMBERS = """
m AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name, c_custkey // 20 + 1 AS page_id,
        CASE WHEN c_custkey % 3 = 0 THEN '여' ELSE '남' END AS gender, (c_nationkey % 5 + 1) || '선' AS won
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


MEMBER_ELEMENTS = 20
"""Elements of a member on a list page that are kept, at most about."""


def html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def list_pages(spark, sf_dir) -> DataFrame:
    """Pages with photo cards and the member table; rows of negative balances are cut short."""
    key, name, party = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    card = html(
        "<li><a class='nassem_reslut_pic'><div><img src='/photo/", key, ".png'></div><span><i>", party, "</i> ", name,
        "</span></a></li>",
    )
    named = html("<td><a class='hgNm' onclick=\"memberDetail('", key, "')\">", name, "</a></td>")
    head = html("<tr><td>", key, "</td><td>제22대</td>", named)
    rest = html(
        "<td>", party, "</td><td>위원회 ", F.col("n_name"), "</td><td>", F.col("n_name"), "</td><td>",
        F.when(key % 3 == 0, "여").otherwise("남"), "</td><td>", F.col("c_nationkey") % 5 + 1, "선</td><td>지역구</td>",
    )
    row = html(head, F.when(F.col("c_acctbal") < 0, "").otherwise(rest), "</tr>")
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )

    def all_of(part: str) -> Column:
        return F.array_join(F.transform("parts", lambda p: p[part]), "")

    # twenty customers per page; a given number of partitions is not put together again, and
    # parsing, the heavy part, follows in the same tasks
    rows = max(MEMBER_ELEMENTS * table(spark, sf_dir, "customer").count(), TASK_ROWS * spark.sparkContext.defaultParallelism)
    placed = by_key(people.withColumn("page_id", F.floor(key / 20) + 1), "page_id", rows)
    pages = placed.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(key, card.alias("card"), row.alias("row")))).alias("parts")
    )
    return pages.select(
        "page_id",
        html(
            "<html><body><ul class='nassem_result_ul'>", all_of("card"), "</ul><table><thead><tr><th>번호</th><th>대수</th>"
            "</tr></thead><tbody id='list-result-sect'>", all_of("row"), "</tbody></table></body></html>",
        ).alias("html"),
    )


def _by_page(spark, sf_dir, elements: DataFrame) -> DataFrame:
    return by_key(elements, "page_id", MEMBER_ELEMENTS * table(spark, sf_dir, "customer").count())


def _list_elements(spark, sf_dir, tags) -> DataFrame:
    return _by_page(spark, sf_dir, pg.html_elements(list_pages(spark, sf_dir), set(tags)))


@query(
    f"""WITH {MEMBERS} SELECT page_id, CAST(c_custkey AS VARCHAR) AS number, '제22대' AS daesu, c_name AS name,
      c_mktsegment AS party, '위원회 ' || n_name AS committee, n_name AS region, gender, won AS election_count,
      '지역구' AS election_method, '{PREFIX}' || c_custkey AS detail_link FROM m WHERE c_acctbal >= 0"""
)
def member_list(spark, sf_dir):
    return profiles.member_list(_list_elements(spark, sf_dir, profiles.LIST_TAGS), PREFIX).drop("seq")


CARDS = """cards AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c_custkey) - 1 AS index FROM m)"""


@query(
    f"""WITH {MEMBERS}, {CARDS} SELECT page_id, index, c_name AS name, c_mktsegment AS party,
      '/photo/' || c_custkey || '.png' AS photo_url, c_name || '.png' AS photo_filename FROM cards"""
)
def photo_cards(spark, sf_dir):
    return profiles.photo_cards(_list_elements(spark, sf_dir, profiles.CARD_TAGS))


ASSEMBLED = """SELECT page_id, index, c_name AS name, c_mktsegment AS party,
  CAST((page_id - 1) * 30 + index + 1 AS VARCHAR) AS "monaCd", '22' AS "unitCd",
  CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS rownum, '제22대' AS unit,
  CASE WHEN c_acctbal < 0 THEN '' ELSE '위원회 ' || n_name END AS committees,
  CASE WHEN c_acctbal < 0 THEN '' ELSE n_name END AS region,
  CASE WHEN c_acctbal < 0 THEN '' ELSE won END AS election_count FROM cards"""
ASSEMBLED_COLUMNS = [
    "page_id", "index", "name", "party", "monaCd", "unitCd", "rownum", "unit", "committees", "region",
    "election_count",
]


def _assembled(spark, sf_dir) -> DataFrame:
    # cards and list rows come from one parse
    parsed = pg.html_elements(list_pages(spark, sf_dir), profiles.LIST_TAGS | profiles.CARD_TAGS)
    elements = _by_page(spark, sf_dir, cut(parsed))
    return profiles.cards_with_list(
        profiles.photo_cards(elements),
        profiles.member_list(elements, PREFIX, by_anchor=True),
        F.col("page_id"),
        "22",
    ).select(*ASSEMBLED_COLUMNS)


@query(f"WITH {MEMBERS}, {CARDS} {ASSEMBLED}")
def roster_assembly(spark, sf_dir):
    """Cards joined to the list row of their page and name, with defaults."""
    return _assembled(spark, sf_dir)


@query(f"WITH {MEMBERS}, {CARDS} {ASSEMBLED} ORDER BY page_id, index LIMIT 300")
def first_records(spark, sf_dir):
    """The record cap of a collection run; the number is the operator."""
    return profiles.first_records(_assembled(spark, sf_dir), 300)


@query(
    f"""WITH {MEMBERS}, t AS (SELECT page_id, c_custkey, c_name, c_acctbal,
        row_number() OVER (PARTITION BY page_id ORDER BY c_custkey) + 1 AS row FROM m)
    SELECT page_id, 1 AS row, '번호|대수' AS cells FROM (SELECT DISTINCT page_id FROM m)
    UNION ALL
    SELECT t.page_id, row, CASE WHEN t.c_acctbal < 0 THEN t.c_custkey || '|제22대|' || t.c_name
      ELSE t.c_custkey || '|제22대|' || t.c_name || '|' || m.c_mktsegment || '|위원회 ' || n_name || '|' || n_name || '|' ||
        gender || '|' || won || '|지역구' END
    FROM t JOIN m ON m.c_custkey = t.c_custkey WHERE row <= 3"""
)
def table_heads(spark, sf_dir):
    """The first three rows of every table; the small number is the report itself."""
    rows = pg.table_rows(_list_elements(spark, sf_dir, {"td", "th", "tr", "table"}), 3)
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query(
    """WITH r AS (SELECT c_custkey, c_custkey // 3 + 1 AS page_id, c_acctbal FROM customer),
    e AS (SELECT coalesce(min(page_id), 21) AS stop FROM (
      SELECT page_id FROM r GROUP BY page_id HAVING max(c_acctbal) <= 1500))
    SELECT c_custkey, page_id FROM r, e WHERE c_acctbal > 1500 AND page_id <= 20 AND page_id < stop"""
)
def pages_before_gap(spark, sf_dir):
    """A page walk ends at the first page without rows, or after page 20; both are the operator."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.floor(F.col("c_custkey") / 3) + 1).alias("page_id"), "c_acctbal"
    )
    walked = rows.select("page_id").distinct()
    found = profiles.pages_before_gap(rows.where(F.col("c_acctbal") > 1500), walked, 20)
    return found.select("c_custkey", "page_id")


# --- detail pages built from suppliers -------------------------------------------------------

SUPPLIERS = """
s AS (SELECT s_suppkey, s_name, s_acctbal, n_name, '02-' || (s_suppkey % 900 + 100) || '-' || (s_suppkey % 9000 + 1000) AS phone
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def supplier_table(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("page_id"),
            key,
            "s_name",
            "s_acctbal",
            "n_name",
            html("02-", key % 900 + 100, "-", key % 9000 + 1000).alias("phone"),
        )
    )


def detail_pages(spark, sf_dir) -> DataFrame:
    """Profile, contact, career and photo areas; negative balances lack the contact area."""
    nation = F.col("n_name")
    contact = html(
        "<div class='contact_area'><ul><li><strong>사무실 전화</strong>", F.col("phone"),
        "</li><li><strong>선거구</strong>선거구 ", nation, "</li></ul></div>",
    )
    page = html(
        "<html><body><div class='profile_area'><span class='party'> ", nation, "당 </span><ul class='profile_list'>",
        "<li><strong>선거구</strong>서울 ", nation, "</li><li><strong>이름</strong>", F.col("s_name"), "</li></ul></div>",
        F.when(F.col("s_acctbal") < 0, "").otherwise(contact),
        "<div class='career_area'><ul><li>가나대학교 졸업</li><li>", nation, " 위원</li></ul></div>",
        "<div class='photo_area'><img src='../img/", F.col("s_suppkey"), ".jpeg'></div>",
        "<form action='/find' method='post'><input type='hidden' name='code' value='", F.col("s_suppkey"),
        "'><input type='hidden' name='' value='x'><input type='text' name='q' value=''></form>",
        "<form><input type='hidden' name='late' value='1'></form>",
        "<dl><dt>이름</dt><dd>", F.col("s_name"), "</dd><dt>국가</dt><dd>", nation, "</dd><dt>끝</dt></dl></body></html>",
    )
    return supplier_table(spark, sf_dir).withColumn("html", page)


DETAIL_URL = "https://members.example.org/22nd/A/B"


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, n_name || '당' AS detailed_party,
      'https://members.example.org/22nd/img/' || s_suppkey || '.jpeg' AS photo_url, '의원_A.jpeg' AS photo_filename,
      CASE WHEN s_acctbal < 0 THEN '서울 ' || n_name ELSE n_name END AS district,
      CASE WHEN s_acctbal < 0 THEN '' ELSE phone END AS phone, s_name AS named,
      '가나대학교 졸업;' || n_name || ' 위원' AS careers FROM s"""
)
def detail_profiles(spark, sf_dir):
    elements = pg.html_elements(detail_pages(spark, sf_dir), profiles.DETAIL_TAGS)
    rows = profiles.detail_profiles(elements, F.lit(DETAIL_URL), F.lit("의원 A!"))
    extra = F.col("extra")
    return rows.select(
        "page_id",
        "detailed_party",
        "photo_url",
        "photo_filename",
        extra["선거구"].alias("district"),
        F.coalesce(extra["사무실 전화"], F.lit("")).alias("phone"),
        extra["이름"].alias("named"),
        F.array_join(profiles.CAREER, ";").alias("careers"),
    )


@query(
    f"""WITH {SUPPLIERS}, listed AS (SELECT s_suppkey AS page_id, s_name AS name, 'old' AS photo_url FROM s)
    SELECT page_id, name, 'https://members.example.org/22nd/img/' || page_id || '.jpeg' AS photo_url FROM listed"""
)
def records_with_details(spark, sf_dir):
    """List records updated from their detail pages."""
    elements = pg.html_elements(detail_pages(spark, sf_dir), profiles.DETAIL_TAGS)
    details = profiles.detail_profiles(elements, F.lit(DETAIL_URL))
    listed = supplier_table(spark, sf_dir).select("page_id", F.col("s_name").alias("name"), F.lit("old").alias("photo_url"))
    return profiles.with_details(listed, details, "page_id").select("page_id", "name", "photo_url")


def direct_pages(spark, sf_dir) -> DataFrame:
    """Free-form member pages; every third one names its party only in running text."""
    key, nation = F.col("s_suppkey"), F.col("n_name")
    party = (
        F.when(key % 3 == 0, "<p>무소속에서 개혁신당, 정의당으로</p>")
        .when(key % 3 == 1, "<div class='party'>정의당</div>")
        .otherwise("<span>더불어민주당 원내</span>")
    )
    page = html(
        "<h1>국회의원 ", F.col("s_name"), "</h1>", party,
        "<section class='member_info'><ul><li>선거구 ", nation, "</li><li>소속위원회 위원회", nation,
        "</li><li>당선횟수 3선</li><li>사무실 전화 없음</li><li>이메일 없음</li></ul></section>",
        "<div class='career'><ul><li>경력 ", key, "</li><li> </li></ul></div><img src='a.svg'><img src='/p/", key, ".PNG'>",
        F.when(F.col("s_acctbal") < 0, "").otherwise(html("<p>", F.col("phone"), " 또는 m", key, "@na.example.kr</p>")),
    )
    return supplier_table(spark, sf_dir).withColumn("html", page)


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, s_name AS name,
      CASE s_suppkey % 3 WHEN 0 THEN '정의당' WHEN 1 THEN '' ELSE '더불어민주당 원내' END AS party, n_name AS region,
      '위원회' || n_name AS committee, '3선' AS election_count,
      CASE WHEN s_acctbal < 0 THEN '없음' ELSE phone END AS phone,
      CASE WHEN s_acctbal < 0 THEN '이메일 없음' ELSE 'm' || s_suppkey || '@na.example.kr' END AS email,
      '경력 ' || s_suppkey AS career, 'https://members.example.org/p/' || s_suppkey || '.PNG' AS photo_url,
      regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g') || '.PNG' AS photo_filename FROM s"""
)
def direct_profiles(spark, sf_dir):
    elements = pg.html_elements(direct_pages(spark, sf_dir), profiles.DETAIL_TAGS)
    rows = profiles.direct_profiles(elements, F.lit(DETAIL_URL))
    return rows.withColumns(
        {"party": F.coalesce("party", F.lit("")), "career": F.array_join("career", ";")}
    )


@query(f"WITH {SUPPLIERS} SELECT s_suppkey AS page_id, 'code' AS name, CAST(s_suppkey AS VARCHAR) AS value FROM s")
def hidden_fields(spark, sf_dir):
    elements = pg.html_elements(detail_pages(spark, sf_dir), {"form", "input"})
    return pg.hidden_fields(elements).select("page_id", F.explode("fields").alias("name", "value"))


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, '/find' AS action, 'code' AS name, 'hidden' AS type FROM s
    UNION ALL SELECT s_suppkey, '/find', '', 'hidden' FROM s UNION ALL SELECT s_suppkey, '/find', 'q', 'text' FROM s
    UNION ALL SELECT s_suppkey, '', 'late', 'hidden' FROM s"""
)
def form_inventory(spark, sf_dir):
    elements = pg.html_elements(detail_pages(spark, sf_dir), {"form", "input"})
    return pg.forms(elements).select("page_id", "action", "name", "type")


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, 0 AS place, '이름' AS term, s_name AS text FROM s
    UNION ALL SELECT s_suppkey, 1, '국가', n_name FROM s"""
)
def definition_lists(spark, sf_dir):
    elements = pg.html_elements(detail_pages(spark, sf_dir), {"dt", "dd", "dl"})
    return pg.definitions(elements).select("page_id", "place", "term", "text")


def picture_pages(spark, sf_dir) -> DataFrame:
    """Pages with images, style pictures and data attributes from suppliers."""
    key = F.col("s_suppkey")
    page = html(
        "<div class='photo_box' id='d", key, "'><img class='x' src='/member/", key, ".png' alt='사진 ", F.col("n_name"),
        "' title='t.png'></div><p><img src='/i/", key, ".gif' alt=''></p>",
        "<span style=\"background-image:\n url('/bg/", key, ".jpg')\"></span>",
        "<span style='background-image: url(/img/Facebook.png)'></span>",
        "<b data-photo='", key, ".jpg' data-n='", F.col("n_name"), "'>b</b>",
    )
    return supplier_table(spark, sf_dir).withColumn("html", page)


@query(
    f"""WITH {SUPPLIERS}
    SELECT s_suppkey AS page_id, 'https://members.example.org/member/' || s_suppkey || '.png' AS full_url,
      '사진 ' || n_name AS alt, 'x' AS classes, 'div' AS parent_tag, 'photo_box' AS parent_classes, 'd' || s_suppkey AS parent_id FROM s
    UNION ALL SELECT s_suppkey, 'https://members.example.org/i/' || s_suppkey || '.gif', '', '', 'p', '', '' FROM s"""
)
def image_inventory(spark, sf_dir):
    elements = pg.html_elements(picture_pages(spark, sf_dir), {"img"})
    return pg.images(elements, F.lit(LIST_URL)).select(
        "page_id", "full_url", "alt", "classes", "parent_tag", "parent_classes", "parent_id"
    )


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, 'alt' AS basis, '/member/' || s_suppkey || '.png' AS src FROM s
    UNION ALL SELECT s_suppkey, 'path', '/member/' || s_suppkey || '.png' FROM s"""
)
def photo_candidates(spark, sf_dir):
    elements = pg.html_elements(picture_pages(spark, sf_dir), {"img"})
    return pg.photo_candidates(pg.images(elements, F.lit(LIST_URL))).select("page_id", "basis", "src")


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, '/bg/' || s_suppkey || '.jpg' AS img_path,
      'https://members.example.org/bg/' || s_suppkey || '.jpg' AS img_url FROM s"""
)
def background_images(spark, sf_dir):
    elements = pg.html_elements(picture_pages(spark, sf_dir), {"span"})
    return pg.background_images(elements, F.lit(LIST_URL)).drop("seq")


@query(
    f"""WITH {SUPPLIERS} SELECT s_suppkey AS page_id, 'data-photo' AS name, s_suppkey || '.jpg' AS value, 1 AS is_image FROM s
    UNION ALL SELECT s_suppkey, 'data-n', n_name, 0 FROM s"""
)
def data_attributes(spark, sf_dir):
    elements = pg.html_elements(picture_pages(spark, sf_dir), {"b", "img", "span", "div"})
    found = pg.data_attributes(elements).select("page_id", "name", "value", "is_image")
    return found.withColumn("is_image", F.col("is_image").cast("int"))
