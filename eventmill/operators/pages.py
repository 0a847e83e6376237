"""HTML pages to Markdown-like text.

A page is cut into tokens, and what a converter would keep as running state (depth of quotes and lists, open links,
pending paragraph breaks) is read off with windows over the tokens of the page. Pages are spread by id once; windows
and aggregates after that stay where the page is. Nothing larger than one page is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.functions.plain_text import entity_text, unescape
from eventmill.functions.urls import resolve_url

_ATTRS = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
# In this order: comment, declaration, script or style with its raw content, tag, tag with broken quotes,
# entity, text, stray mark.
_TOKEN = (
    r"(?is)<!--.*?-->|<[!?][^>]*+>"
    rf"|<(script|style)(?=[\s>]){_ATTRS}(?<!/)>.*?(?=</\1\s*+>|\z)"
    rf"|</?[a-z]{_ATTRS}>|</?[a-z][^<>]*+>"
    r"|&\#(?:[0-9]++|x[0-9a-f]++)(?:;|(?=[^0-9a-z]))|&[a-z][-.a-z0-9]*+(?:;|(?=[^a-z0-9]))"
    r"|[^<&]++|[<&]"
).replace(r"\#", "#")
_END = ""  # token after the last one
_EMPHASIS = {"em": "_", "i": "_", "u": "_", "strong": "**", "b": "**"}
_SILENT = ["head", "style", "script"]
_HEADINGS = [f"h{n}" for n in range(1, 10)]


def _attribute(tag: Column, name: str) -> Column:
    """Last value given for an attribute, entities replaced; NULL when it is not there."""
    quoted = rf"""(?i)[\s"']{name}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
    given = F.regexp_replace(F.try_element_at(F.regexp_extract_all(tag, F.lit(quoted), F.lit(0)), F.lit(-1)), r"^[^=]*=\s*", "")
    return unescape(F.regexp_replace(given, r"""^["']|["']$""", ""))


def _tokens(html: Column) -> Column:
    """Tokens in order; `<br/>` counts as opened and closed, comments and declarations are left out."""
    html = F.replace(html, F.lit("</' + 'script>"), F.lit("</ignore>"))
    found = F.filter(
        F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), lambda t: ~(t.startswith("<!") | t.startswith("<?"))
    )

    def split(t: Column) -> Column:
        pair = F.array(t, F.concat(F.lit("</"), F.regexp_extract(t, r"^<([^\s/>]+)", 1), F.lit(">")))
        return F.when(t.rlike(r"(?s)^<[a-zA-Z].*/>$"), pair).otherwise(F.array(t))

    return F.concat(F.flatten(F.transform(found, split)), F.array(F.lit(_END)))


def page_tokens(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per token `(key, pos, token, tag, opens)`, pages spread by key."""
    spread = df.select(key, html).repartition(key)
    rows = spread.select(key, F.posexplode(_tokens(F.coalesce(F.col(html), F.lit("")))).alias("pos", "token"))
    # text never starts with the mark, except where the mark is all there is
    is_tag = F.col("token").startswith("<") & (F.length("token") > 1)
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][^\s/>]*)", 1))
    return rows.select(
        "*", F.when(is_tag, name).alias("tag"), (is_tag & ~F.col("token").startswith("</")).alias("opens")
    )


def _running(rows: DataFrame, key: str) -> DataFrame:
    """What is open at each token: silence, quotes, preformatted text, lists, links."""
    tag, opens = F.col("tag"), F.col("opens")
    one = F.when(opens, 1).otherwise(-1)
    in_page = Window.partitionBy(key).orderBy("pos")
    here = in_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_page.rowsBetween(Window.unboundedPreceding, -1)

    stray = F.when(F.col("token").contains(r"\/script>"), 1).otherwise(0)
    silence = F.when(tag.isin(_SILENT), one).otherwise(0) - F.when(tag.isNull() | tag.isin("script", "style"), stray).otherwise(0)
    lists, links = [F.when(tag.isin(names), one).otherwise(0) for names in (["ol", "ul"], ["a"])]
    listed = F.when(tag.isNotNull() & ~(tag.isin(_HEADINGS) & ~opens), tag.isin("ol", "ul"))
    rows = rows.select(
        "*",
        F.sum(silence).over(here).alias("silence"),
        F.sum(F.when(tag == "blockquote", one).otherwise(0)).over(here).alias("quotes"),
        F.coalesce(F.last(F.when(tag == "pre", opens), True).over(here), F.lit(False)).alias("pre"),
        F.sum(lists).over(here).alias("lists"),
        F.sum(links).over(here).alias("links"),
        F.coalesce(F.last(listed, True).over(before), F.lit(False)).alias("after_list"),
    )

    # closing tags without an opening one do not count: the depth never goes below 0
    def depth(name: str) -> Column:
        return F.col(name) - F.least(F.lit(0), F.min(name).over(here))

    def depth_before(name: str, step: Column) -> Column:
        return F.col(name) - step - F.least(F.lit(0), F.coalesce(F.min(name).over(before), F.lit(0)))

    body = F.last(F.when(tag == "body", F.col("silence")), True).over(here)
    return rows.select(
        *[c for c in rows.columns if c not in ("silence", "lists", "links")],
        (F.col("silence") - F.coalesce(body, F.lit(0)) != 0).alias("quiet"),
        depth("lists").alias("lists"),
        depth("links").alias("links"),
        depth_before("lists", lists).alias("lists_before"),
        depth_before("links", links).alias("links_before"),
    )


def _matched(rows: DataFrame, key: str) -> DataFrame:
    """The list a list item is in with its number, and the link a closing tag ends."""
    tag, opens = F.col("tag"), F.col("opens")
    level = F.when(tag == "a", F.when(opens, F.col("links")).otherwise(F.col("links_before"))).when(
        tag.isin("ol", "ul", "li"), F.col("lists")
    )
    kind = F.when(tag == "a", "a").when(tag.isin("ol", "ul", "li"), "list")
    rows = rows.withColumn("level", level).withColumn("kind", kind)
    same = Window.partitionBy(key, "kind", "level").orderBy("pos")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    href = F.when((tag == "a") & opens, _attribute(F.col("token"), "href"))
    target = F.when(~href.startswith("#"), href)
    title = F.when((tag == "a") & opens, _attribute(F.col("token"), "title"))
    start = F.coalesce(_attribute(F.col("token"), "start").try_cast("int") - 1, F.lit(0))
    opened = F.when(
        tag.isin("a", "ol", "ul") & opens,
        F.struct(tag.alias("tag"), target.alias("target"), title.alias("title"), start.alias("start")),
    )
    items = F.when((tag == "li") & opens, 1).otherwise(0)
    rows = rows.withColumn("own", opened).withColumn("items", F.sum(items).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    top = F.struct(F.col("own").alias("own"), F.col("items").alias("items"))
    rows = rows.withColumn("top", F.last(F.when(F.col("own").isNotNull(), top), True).over(before))
    return rows.drop("kind", "level")


def _numbered_links(rows: DataFrame, key: str) -> DataFrame:
    """Add `number` where a link ends or an image is, and `linked` where its address and title come for the first time.

    The numbers of a page run from 1 in the order of first use; a link has been used when it ends.
    """
    tag, opens, own = F.col("tag"), F.col("opens"), F.col("top")["own"]
    source, title = _attribute(F.col("token"), "src"), _attribute(F.col("token"), "title")
    ended = F.when((F.col("links_before") > 0) & own["target"].isNotNull(), F.struct(own["target"].alias("target"), own["title"].alias("title")))
    image = F.when(source.isNotNull(), F.struct(source.alias("target"), title.alias("title")))
    rows = rows.withColumn("ref", F.when((tag == "a") & ~opens, ended).when((tag == "img") & opens, image))
    same = Window.partitionBy(key, "ref")
    rows = rows.withColumn("new", F.col("ref").isNotNull() & (F.min("pos").over(same) == F.col("pos")))
    here = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("count", F.sum(F.col("new").cast("int")).over(here))
    number = F.when(F.col("ref").isNotNull(), F.min("count").over(same))
    linked = F.when(F.col("new"), F.struct(F.col("count").alias("number"), F.col("pos").alias("pos"), "ref.target", "ref.title"))
    return rows.select("*", number.alias("number"), linked.alias("linked")).drop("new", "count", "ref")


_LINKED = "struct<number:bigint,pos:int,target:string,title:string>"


def _pieces(rows: DataFrame, key: str, list_mark: str, inline: bool = True) -> DataFrame:
    """`(key, pos, piece, last, noted, linked)` for the tokens that write something, and the last one: the text with the break in front of it."""
    rows = rows.withColumn("linked", F.lit(None).cast(_LINKED)) if inline else _numbered_links(rows, key)
    tag, opens, pre = F.col("tag"), F.col("opens"), F.col("pre")
    heading = tag.isin(_HEADINGS)
    top = F.col("top")
    number = (top["own"]["start"] + F.col("items") - top["items"]).cast("string")
    in_order = (F.col("lists") > 0) & (top["own"]["tag"] == "ol")
    marker = F.when(in_order, F.concat(number, F.lit(". "))).otherwise(F.lit(f"{list_mark} "))
    source = _attribute(F.col("token"), "src")
    image = F.concat(F.lit("!["), F.coalesce(_attribute(F.col("token"), "alt"), F.lit("")))
    if inline:
        image = F.concat(image, F.lit("]("), source, F.lit(")"))
        link_end = F.when(F.col("links_before") > 0, F.concat(F.lit("]("), top["own"]["target"], F.lit(")")))
    else:
        link_end = F.concat(F.lit("]["), F.col("number").cast("string"), F.lit("]"))
        image = F.concat(image, link_end)
    written = (
        F.when(tag.isNull(), F.when(F.col("token").startswith("&"), entity_text(F.col("token"))).otherwise(F.col("token")))
        .when(heading & opens, F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")))
        .when((tag == "br") & opens, "  \n")
        .when((tag == "hr") & opens, "* * *")
        .when((tag == "blockquote") & opens, "> ")
        .when(tag.isin(*_EMPHASIS), F.when(tag.isin("strong", "b"), "**").otherwise("_"))
        .when(tag.isin("del", "strike"), F.concat(F.when(opens, "<").otherwise("</"), tag, F.lit(">")))
        .when((tag == "code") & ~pre, "`")
        .when((tag == "a") & opens, F.when(F.col("own.target").isNotNull(), "["))
        .when((tag == "a") & ~opens, link_end)
        .when((tag == "img") & opens, image)
        .when((tag == "dd") & opens, "    ")
        .when((tag == "li") & opens, F.concat(F.repeat(F.lit("  "), F.col("lists").cast("int")), marker))
    )
    breaks = (
        F.when(heading | tag.isin("p", "div", "blockquote", "pre"), 2)
        .when(tag.isin("hr", "dl", "table", "tr") & opens, 2)
        .when(tag.isin("ol", "ul") & (F.col("lists_before") == 0) & ~F.col("after_list"), 2)
        .when(tag.isin("li", "td"), 1)
        .when(tag.isin("dt", "dd") & ~opens, 1)
        .otherwise(0)
    )
    pure = tag.isNull() & ~pre
    opens_quote = F.coalesce((tag == "blockquote") & opens, F.lit(False))
    # a quote is opened with the marks of the quote around it
    quotes = F.col("quotes") - F.when(opens_quote, 1).otherwise(0)
    margin = F.concat(
        F.repeat(F.lit(">"), F.greatest(quotes, F.lit(0)).cast("int")),
        F.when((quotes != 0) & ~opens_quote, " ").otherwise(""),
        F.when(pre, "    ").otherwise(""),
    )
    rows = rows.select(
        key, "pos", "tag", "opens", "pre", "quiet", "linked", (F.col("token") == _END).alias("last"), breaks.alias("breaks"),
        opens_quote.alias("opens_quote"), margin.alias("margin"), written.alias("raw"),
        F.when(tag == "abbr", F.struct(opens.alias("opens"), F.when(opens, _attribute(F.col("token"), "title")).alias("title"))).alias("abbr"),
    ).withColumn("text", F.when(pure, F.regexp_replace("raw", r"\s+", " ")).otherwise(F.col("raw")))
    spaced = F.coalesce(pure & F.col("text").startswith(" "), F.lit(False))
    rows = rows.select(
        "*", (spaced & ~F.col("quiet")).alias("spaced"), F.when(spaced, F.substring("text", 2, 1 << 30)).otherwise(F.col("text")).alias("data")
    ).withColumn("writes", ~F.col("quiet") & (F.coalesce(F.length("data") > 0, F.lit(False)) | F.col("last")))

    # Marks pending at a token are those younger than the last token that wrote. A token asks for its break before it
    # writes (2 * pos) and for what follows it afterwards (2 * pos + 1).
    in_page = Window.partitionBy(key).orderBy("pos")
    here = in_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_page.rowsBetween(Window.unboundedPreceding, -1)
    asks, follows = F.col("pos") * 2, F.col("pos") * 2 + 1
    paragraph = F.max(F.when((tag == "hr") & opens, follows).when(F.col("breaks") == 2, asks))
    written_before = F.max(F.when(F.col("writes"), asks)).over(before)
    restart = F.coalesce(F.max(F.when(F.col("opens_quote") | ((tag == "li") & opens), follows)).over(before), F.lit(-1))
    rows = rows.select(
        key, "pos", "tag", "last", "pre", "margin", "data", "raw", "writes", "linked",
        F.coalesce(written_before, F.lit(-2)).alias("since"),
        # a rule has a paragraph break on both sides; of its own only the one in front counts here
        F.greatest(F.coalesce(paragraph.over(before), F.lit(-2)), F.when(F.col("breaks") == 2, asks).otherwise(-2)).alias("paragraph"),
        F.coalesce(F.max(F.when(F.col("breaks") == 1, asks)).over(here), F.lit(-2)).alias("line"),
        restart.alias("restart"),
        F.coalesce(F.max(F.when(F.col("spaced"), asks)).over(here), F.lit(-2)).alias("space"),
        F.coalesce(F.last(F.when(F.col("writes"), F.col("data").endswith("\n")), True).over(before), F.lit(False)).alias("line_ended"),
        F.last("abbr", True).over(here).alias("about"),
        F.last("abbr", True).over(before).alias("about_before"),
        F.count("abbr").over(here).alias("abbr"),
    )
    since = F.col("since")
    lead = (
        F.when(F.col("last"), "\n")
        .when(F.col("restart") > since, "")
        .when(F.col("paragraph") > since, F.repeat(F.concat(F.lit("\n"), F.col("margin")), F.lit(2)))
        .when(F.col("line") > since, F.concat(F.lit("\n"), F.col("margin")))
        .when((F.col("space") > since) & ~F.col("line_ended"), " ")
        .otherwise("")
    )
    data = F.when(pre, F.replace("data", F.lit("\n"), F.concat(F.lit("\n"), F.col("margin")))).otherwise(F.col("data"))
    is_abbr = F.coalesce(tag == "abbr", F.lit(False))
    nothing = F.lit(None).cast("string")
    noted = F.when(
        ~is_abbr & F.col("about.title").isNotNull(),
        F.struct("abbr", "pos", F.coalesce("raw", F.lit("")).alias("text"), nothing.alias("title")),
    ).when(
        is_abbr & ~F.col("about.opens") & F.col("about_before.title").isNotNull(),
        F.struct((F.col("abbr") - 1).alias("abbr"), "pos", nothing.alias("text"), F.col("about_before.title").alias("title")),
    )
    return rows.select(
        key, "pos", "last", F.when(F.col("writes"), F.concat(lead, F.coalesce(data, F.lit("")))).alias("piece"), noted.alias("noted"), "linked"
    ).where(F.col("piece").isNotNull() | F.col("noted").isNotNull() | F.col("linked").isNotNull() | F.col("last"))


def _definitions(noted: Column) -> Column:
    """Lines that explain the abbreviations of a page, in the order they are used."""
    defined = F.filter(noted, lambda n: n["title"].isNotNull())

    def term(d: Column) -> Column:
        parts = F.filter(noted, lambda n: (n["abbr"] == d["abbr"]) & n["title"].isNull())
        return F.struct(F.array_join(F.transform(parts, lambda n: n["text"]), "").alias("key"), d["title"].alias("value"))

    terms = F.map_from_entries(F.transform(defined, term))
    lines = F.transform(F.map_entries(terms), lambda t: F.concat(F.lit("  *["), t["key"], F.lit("]: "), t["value"], F.lit("\n")))
    return F.array_join(lines, "")


def _link_lines(linked: Column, written: Column, base: Column | None) -> Column:
    """The numbered addresses of a page, of those links behind which something was written."""
    shown = F.filter(linked, lambda x: x["pos"] <= written)

    def line(x: Column) -> Column:
        target = x["target"] if base is None else resolve_url(base, x["target"])
        title = F.when(x["title"].isNotNull(), F.concat(F.lit(" ("), x["title"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("   ["), x["number"].cast("string"), F.lit("]: "), target, title, F.lit("\n"))

    return F.concat(F.lit("\n"), F.array_join(F.transform(shown, line), ""), F.when(F.size(shown) > 0, "\n").otherwise(""))


def pages_to_text(
    df: DataFrame, key: str = "page_id", html: str = "html", list_mark: str = "*", width: int = 78, inline_links: bool = True,
    base: Column | None = None,
) -> DataFrame:
    """`(key, text)`: each page as Markdown-like text, wrapped at `width` characters (0: not at all).

    `key` names a column that is unique per page. Without `inline_links`, links and images are numbered, and their
    addresses follow at the end of the page, resolved against `base`, an expression over the columns of the page.
    """
    pieces = _pieces(_matched(_running(page_tokens(df, key, html), key), key), key, list_mark, inline_links)
    piece = F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))
    pages = pieces.groupBy(key).agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.array_sort(F.collect_list("noted")).alias("noted"),
        F.max(F.col("last") & F.col("piece").isNotNull()).alias("ended"),
        F.array_sort(F.collect_list("linked")).alias("linked"),
        F.coalesce(F.max(F.when(F.col("piece").isNotNull() & ~F.col("last"), F.col("pos"))), F.lit(-1)).alias("written"),
    )
    notes = F.when(F.col("ended") & (F.size("noted") > 0), _definitions(F.col("noted"))).otherwise("")
    if not inline_links:
        if base is not None:
            pages = pages.join(df.select(F.col(key), base.alias("base")), key)
        addresses = _link_lines(F.col("linked"), F.col("written"), None if base is None else F.col("base"))
        notes = F.concat(F.when(F.col("ended") & (F.size("linked") > 0), addresses).otherwise(""), notes)
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), notes)
    return pages.select(key, wrap_paragraphs(text, width).alias("text"))


# A place inside a word where a line may end: after a hyphen between letters, around a dash.
_HYPHEN = r"""(?:(?<=\w[^0-9\W]-)(?=\w+[^0-9\W])|(?<=[\w!"'&.,?])(?=-{2,}\w)|(?<=[\w!"'&.,?]-{2})(?=\w))"""


def wrap_paragraphs(text: Column, width: int = 78) -> Column:
    """Wrap the lines that are neither indented nor list items; at most one empty line in a row."""
    if not width:
        return text
    fits = rf"(.{{0,{width - 1}}}\S)(?:\s+|\z|(?={_HYPHEN}))"
    # a word longer than a line starts where it stands and is cut at the margin
    long_word = rf"(?=(?:.{{0,{width}}}?(?:(?<=\s)|{_HYPHEN}))?\S(?:(?!{_HYPHEN})\S){{{width}}})(.{{{width}}})\s*"

    def wrapped(line: Column) -> Column:
        lines = F.when(
            line.rlike(rf"\S{{{width + 1}}}"), F.regexp_replace(line, rf"(?U){long_word}|{fits}", "$1$2\n")
        ).otherwise(F.regexp_replace(line, rf"(?U){fits}", "$1\n"))
        return (
            F.when(line == "", "\n")
            .when(line.rlike("^ +$"), "")
            .when(line.rlike("^[ *-]"), F.concat(line, F.lit("\n")))
            .otherwise(F.concat(lines, F.lit("\n")))
        )

    joined = F.array_join(F.transform(F.split(text, "\n"), wrapped), "")
    return F.regexp_replace(joined, r"\n{3,}", "\n\n")
