"""Markup by structure: pages as tags, elements as intervals of tags, selectors as windows over intervals.

A page is cut into tags and texts, numbered in order. An element runs from its tag to
the tag that ends it: tags of one name pair up by their running count, elements whose
end may be left out end at what follows them, and those that are never closed end with
the element around them. Depth is a running sum of starts and ends, and the element
around another is the last one before it that is one less deep.

"Inside" is one running maximum of ends, so a selector takes a window for each step
and no join of intervals. The text of an element is a stretch of its page's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.text import collapse

# Fixed values of HTML: elements without content; elements that part texts; containers of elements whose end may be left out.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
#: By element: the tags that open and end it, and the containers within which it counts.
OPTIONAL = {
    "p": (tuple(t for t in BLOCK if t not in ("br", "dd", "dt", "li", "head", "body", "html", "title", "tbody", "td", "tfoot", "th", "thead", "tr")), ()),
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "tbody", "tfoot"), ("table",)),
    "td": (("td", "th", "tr", "tbody", "tfoot"), ("table",)),
    "th": (("td", "th", "tr", "tbody", "tfoot"), ("table",)),
    "option": (("option", "optgroup"), ("select",)),
}
_TOKEN = r"(?s)<!--.*?-->|<(?i:script|style)\b[^>]*>.*?</(?i:script|style)\s*>|<[^<>]*>|[^<]+|<"


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, tag, attrs, from, to): opening and closing tags with the stretch of the page's text that each takes (a space for block tags)."""
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    code = F.col("tag").isin("script", "style")
    kind = F.when(F.rlike("token", F.lit(r"^<[!?]")) | code, "none").when(F.rlike("token", F.lit("^</[A-Za-z]")), "close").when(F.rlike("token", F.lit("^<[A-Za-z]")), "open").otherwise("text")
    parts = parts.withColumn("tag", tag).withColumn("kind", kind).withColumn("piece", _piece())
    upto = F.sum(F.char_length("piece")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    attrs = F.regexp_extract("token", r"(?s)^<[A-Za-z][A-Za-z0-9-]*(.*?)/?>$", 1)
    rows = parts.withColumn("to", upto).withColumn("from", F.col("to") - F.char_length("piece"))
    return rows.select(key, "pos", "kind", "tag", attrs.alias("attrs"), "from", "to", "piece")


def _piece() -> Column:
    """What a token adds to the page's text."""
    return F.when(F.col("kind") == "text", T.decode_entities(F.col("token"))).when(F.col("tag").isin(*BLOCK), F.lit(" ")).otherwise(F.lit(""))


def texts(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text): the whole text of each page, of which ``from`` and ``to`` are places."""
    in_order = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("pos", "piece"))))
    return found.groupBy(key).agg(F.array_join(F.transform(in_order, lambda p: p.piece), "").alias("text"))


def _paired(marks: DataFrame, key: str) -> DataFrame:
    """Ends of elements that are closed by a tag of their own: null where none closes them."""
    opens = F.col("kind") == "open"
    run = F.sum(F.when(opens, 1).otherwise(-1)).over(Window.partitionBy(key, "tag").orderBy("pos"))
    leveled = marks.withColumn("level", run + F.when(opens, 0).otherwise(1))
    same = Window.partitionBy(key, "tag", "level").orderBy("pos")
    closes = F.lead("kind").over(same) == "close"
    return leveled.withColumn("end", F.when(closes, F.lead("pos").over(same))).filter(F.col("kind") == "open").drop("level")


def _ended(marks: DataFrame, key: str, tag: str) -> DataFrame:
    """Ends of elements whose end tag may be left out: their own, or just before what ends them."""
    enders, around = OPTIONAL[tag]
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    rows = marks.filter(F.col("tag").isin(tag, *enders, *around) | (closes & F.col("tag").isin(*BLOCK)))
    inner = F.col("tag").isin(*around) if around else F.lit(False)
    run = F.sum(F.when(inner & opens, 1).when(inner & closes, -1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))
    rows = rows.withColumn("depth", run + F.when(inner & opens, -1).when(inner & closes, 1).otherwise(0))
    outside = ~F.col("tag").isin(*enders, *around) if around else F.lit(True)
    ends = (opens & F.col("tag").isin(*enders)) | (closes & (F.col("tag").isin(tag, *enders, *around) | outside))
    behind = Window.partitionBy(key, "depth").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    first = F.min(F.when(ends, F.struct("pos", (closes & (F.col("tag") == tag)).alias("own")))).over(behind)
    rows = rows.withColumn("first", first).filter(opens & (F.col("tag") == tag))
    return rows.withColumn("end", F.col("first.pos") - F.when(F.col("first.own"), 0).otherwise(1)).drop("first", "depth")


def _nested(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (start, end; null while unknown) with depth, and parent and parent_end, the element around each; those without an end are points."""
    known = F.col("end").isNotNull()
    edges = F.array(F.struct((F.col("start") * 2).alias("at"), F.when(known, 1).otherwise(0).alias("step"), F.lit(True).alias("first")), F.struct((F.col("end") * 2 + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("first")))
    events = rows.select("*", F.explode(edges).alias("edge")).filter("edge.at IS NOT NULL")
    depth = F.sum("edge.step").over(Window.partitionBy(key).orderBy("edge.at"))
    placed = events.withColumn("depth", depth).filter("edge.first").drop("edge").withColumn("over", F.col("depth") - F.when(known, 1).otherwise(0))
    # Each element stands once where it may be the one around others (as deep as it is), and once where it looks for its own.
    twice = placed.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at_depth", F.when(F.col("role") == 0, F.col("depth")).otherwise(F.col("over")))
    mine = F.when((F.col("role") == 0) & known, F.struct("start", "end"))
    before = Window.partitionBy(key, "at_depth").orderBy("start", F.desc("role")).rowsBetween(Window.unboundedPreceding, -1)
    found = twice.withColumn("around", F.last(mine, ignorenulls=True).over(before)).filter("role = 1")
    inside = F.col("around.end") >= F.col("start")
    return found.withColumns({"parent": F.when(inside, F.col("around.start")), "parent_end": F.when(inside, F.col("around.end"))}).drop("role", "at_depth", "around", "over")


def elements(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tag, attrs, start, end, depth, parent, from, to) of each element of tokenized pages."""
    marks = found.filter(F.col("kind").isin("open", "close")).select(key, "pos", "kind", "tag", "attrs")
    void, optional = F.col("tag").isin(*VOID), F.col("tag").isin(*OPTIONAL)
    parts = [marks.filter(void & (F.col("kind") == "open")).withColumn("end", F.col("pos")), _paired(marks.filter(~void & ~optional), key)]
    parts += [_ended(marks, key, tag) for tag in OPTIONAL]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumnRenamed("pos", "start").drop("kind")
    last = found.groupBy(key).agg(F.max("pos").alias("last"))
    filled = _nested(rows, key).join(last, key).withColumn("end", F.coalesce("end", "parent_end", "last"))
    whole = _nested(filled.drop("depth", "parent", "parent_end", "last"), key).drop("parent_end")
    begins = found.select(key, F.col("pos").alias("start"), F.col("to").alias("from"))
    stops = found.select(key, F.col("pos").alias("end"), "to")
    return whole.join(begins, [key, "start"]).join(stops, [key, "end"]).select(key, "tag", "attrs", "start", "end", "depth", "parent", "from", "to")


def attribute(name: str) -> Column:
    """Value of an attribute; null without it."""
    pattern = rf"""(?is)(?:^|\s){re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    there = F.rlike("attrs", F.lit(pattern))
    return F.when(there, T.decode_entities(F.concat(*[F.regexp_extract("attrs", pattern, i) for i in (1, 2, 3)])))


_SIMPLE = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:\s*(\*?=)\s*[\"']?([^\"'\]]*)[\"']?)?\]|\*")


def _matches(compound: str) -> Column:
    """Condition of one part of a selector: tag, #id, .class, [attr], [attr=value], [attr*=part of a value]."""
    out, at = F.lit(True), 0
    while at < len(compound):
        m = _SIMPLE.match(compound, at)
        if not m:
            raise ValueError(f"no selector: {compound}")
        sign, name, attr, how, value = m.groups()
        if attr and how:
            out = out & (attribute(attr) == value if how == "=" else F.contains(attribute(attr), F.lit(value)))
        elif attr:
            out = out & (F.rlike("attrs", F.lit(rf"(?i)(?:^|\s){re.escape(attr)}(?=[\s=/]|$)")))
        elif sign == "#":
            out = out & (attribute("id") == name)
        elif sign == ".":
            out = out & F.array_contains(F.split(collapse(attribute("class")), " "), name)
        elif name:
            out = out & (F.col("tag") == name.lower())
        at = m.end()
    return F.coalesce(out, F.lit(False))


def _steps(selector: str) -> list[tuple[str, str]]:
    words, steps, child = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", selector), [], " "
    for w in words:
        if w == ">":
            child = ">"
        else:
            steps.append((child, w))
            child = " "
    return steps


def marked(rows: DataFrame, selector: str, name: str, key: str = "page_id") -> DataFrame:
    """``rows`` with ``name``: whether the selector (parts by blank or ``>``, alternatives by comma) matches each."""
    out, any_of = rows, F.lit(False)
    for i, alternative in enumerate(selector.split(",")):
        hit = f"{name}__{i}"
        for k, (how, compound) in enumerate(_steps(alternative)):
            fits = _matches(compound)
            if k == 0:
                out = out.withColumn(hit, fits)
            elif how == ">":
                above = out.select(key, F.col("start").alias("parent"), F.col(hit).alias("up__"))
                out = out.join(above, [key, "parent"], "left").withColumn(hit, fits & F.coalesce("up__", F.lit(False))).drop("up__")
            else:
                before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
                reach = F.max(F.when(F.col(hit), F.col("end"))).over(before)
                out = out.withColumn("reach__", reach).withColumn(hit, fits & F.coalesce(F.col("reach__") >= F.col("start"), F.lit(False))).drop("reach__")
        any_of = any_of | F.col(hit)
    return out.withColumn(name, any_of).select(*rows.columns, name)


def select(rows: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    return marked(rows, selector, "hit__", key).filter("hit__").drop("hit__")


def with_text(rows: DataFrame, page_texts: DataFrame, key: str = "page_id", name: str = "text") -> DataFrame:
    """``rows`` with the collapsed text of each element."""
    whole = page_texts.select(key, F.col("text").alias("whole__"))
    piece = F.substring(F.col("whole__"), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    return rows.join(whole, key).withColumn(name, collapse(piece)).drop("whole__")


@dataclass(frozen=True)
class Site:
    """Rules of a site's listing as data.

    ``card`` selects what holds one film; ``fields`` are read once a card, from the
    first element (or the n-th, from 0) that matches; ``rows`` selects the showtimes in
    it, ``row_fields`` say what each gives; ``running`` are labels that count for all
    rows of the card behind them, until the next one. What is read is "text" or the name
    of an attribute; ``card_fields`` are attributes of the card itself.
    """

    card: str
    rows: str
    fields: dict[str, tuple[str, str] | tuple[str, str, int]] = field(default_factory=dict)
    row_fields: dict[str, str] = field(default_factory=dict)
    running: dict[str, tuple[str, str]] = field(default_factory=dict)
    card_fields: dict[str, str] = field(default_factory=dict)


def listing(pages: DataFrame, site: Site, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each row element of a card: key, card, start, the fields, row fields and running labels. Cards within a card belong to it."""
    found = tokens(pages, key, html)
    rows = elements(found, key)
    flags = {"card__": site.card, "row__": site.rows} | {f"field_{n}": f[0] for n, f in site.fields.items()} | {f"label_{n}": s for n, (s, _) in site.running.items()}
    for name, selector in flags.items():
        rows = marked(rows, selector, name, key)
    # The card around an element: the last one that began, if it has not ended; inner cards are none.
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.max(F.when(F.col("card__"), F.col("end"))).over(before) < F.col("start"), F.lit(True))
    rows = rows.withColumn("outer__", F.col("card__") & outer)
    around = F.last(F.when(F.col("outer__"), F.struct("start", "end", *[attribute(a).alias(n) for n, a in site.card_fields.items()])), ignorenulls=True).over(before)
    rows = rows.withColumn("around__", around).filter(F.col("around__.end") >= F.col("start")).withColumn("card", F.col("around__.start"))
    wanted = [n for n in flags if n != "card__"]
    rows = with_text(rows.filter(" OR ".join(wanted)), texts(found, key), key)
    value = lambda what: F.nullif(F.col("text") if what == "text" else attribute(what), F.lit(""))

    inside = Window.partitionBy(key, "card").orderBy("start")
    labels = {n: F.last(F.when(F.col(f"label_{n}"), value(what)), ignorenulls=True).over(inside) for n, (_, what) in site.running.items()}
    times = rows.withColumns(labels).filter("row__").select(key, "card", "start", *site.running, *[F.nullif(F.col(f"around__.{n}"), F.lit("")).alias(n) for n in site.card_fields], *[value(w).alias(n) for n, w in site.row_fields.items()])
    per_card = []
    for n, f in site.fields.items():
        place = F.when(F.col(f"field_{n}"), F.struct("start", value(f[1]).alias("v")))
        ordered = F.array_sort(F.collect_list(place))
        per_card.append(F.try_element_at(F.transform(ordered, lambda x: x.v), F.lit((f[2] if len(f) > 2 else 0) + 1)).alias(n))
    return times.join(rows.groupBy(key, "card").agg(*per_card), [key, "card"]) if per_card else times

