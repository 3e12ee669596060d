"""Page bodies as rows: every element and text of a body with its parent and depth.

``pages``: scope_id, page_id (together a key, either may be null), body (storage markup). A body is cut into tokens, and the
tags' running level tells each token its nearest enclosing element. Bodies whose tags don't pair up are walked tag by tag
with the stack of open elements: an end tag closes what is open inside its element, one without an element is left out, and
what stays open ends with the body.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ["scope_id", "page_id"]
#: Comments, CDATA sections, declarations, tags (quoted values may hold ">") and text; a lone "<" is a token too.
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^<>]*>|</?[A-Za-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
NAME = r"^</?([A-Za-z][A-Za-z0-9:._-]*)"
ATTRIBUTE = r"""([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
VOID = ["hr", "br", "col", "img"]
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The named characters of HTML 4, from Python's table.
NAMED = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}


def unescape(s: Column) -> Column:
    """Named and numbered characters in place of their entities; unknown ones stay."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # one constant

    def char(name: Column) -> Column:
        wide = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.substring(name, 3, 6)).when(F.substring(name, 1, 1) == "#", F.hex(F.substring(name, 2, 7).cast("long")))
        code = F.conv(wide, 16, 10).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(wide, 8, "0")), "UTF-32"))
        return F.coalesce(F.when(wide.isNull(), F.try_element_at(named, name)), numbered, F.concat(F.lit("&"), name, F.lit(";")))

    chars = F.transform(F.regexp_extract_all(s, F.lit(ENTITY), F.lit(1)), char)
    joined = F.array_join(F.zip_with(F.split(s, ENTITY, -1), chars, lambda part, c: F.concat(part, F.coalesce(c, F.lit("")))), "")
    return F.when(s.contains("&"), joined).otherwise(s)


def attribute_pairs(tag: Column) -> Column:
    """array<struct(k, a, b)>: names and values (in quotes of either kind, the other is empty) of a tag's attributes."""
    of = lambda group: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(group))
    found = F.arrays_zip(of(1).alias("k"), of(2).alias("a"), of(3).alias("b"))
    return F.when(tag.contains("="), found).otherwise(F.array().cast("array<struct<k:string,a:string,b:string>>"))


def attributes(pairs: Column) -> Column:
    """attribute_pairs, a column of its own, as a map, values unescaped; of one named twice the last."""
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("key"), unescape(F.concat(p["a"], p["b"])).alias("value"))))


def tokens_of(body: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(TOKEN), F.lit(0))


def broken_at(body: Column) -> Column:
    """Where a tag begins that never ends, in code points from 0; null if none does."""
    tokens = tokens_of(body)
    place = F.array_position(tokens, "<")
    return F.when(place > 0, F.length(F.array_join(F.slice(tokens, 1, (place - 1).cast("int")), "")))


def _kinds(token: Column) -> tuple[Column, Column, Column]:
    """(is a tag, closes, stands alone)."""
    tag = token.rlike("^</?[A-Za-z]")
    closes = token.startswith("</")
    return tag, closes, token.endswith("/>") | F.lower(F.regexp_extract(token, NAME, 1)).isin(VOID)


def _walked(tokens: Column) -> Column:
    """array<struct(at, parent, depth, token)> of the tokens but end tags, by the stack of open elements."""
    stack = "array<struct<name:string,at:int>>"
    out = "array<struct<at:int,parent:int,depth:int,token:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(stack).alias("open"), F.array().cast(out).alias("out"))

    def step(s: Column, token: Column) -> Column:
        tag, closes, alone = _kinds(token)
        name = F.lower(F.regexp_extract(token, NAME, 1))
        back = F.array_position(F.reverse(F.transform(s["open"], lambda x: x["name"])), name)
        left = F.when(back > 0, F.slice(s["open"], 1, (F.size(s["open"]) - back).cast("int"))).otherwise(s["open"])
        pushed = F.concat(s["open"], F.array(F.struct(name.alias("name"), s["at"].alias("at"))))
        row = F.struct(s["at"].alias("at"), F.coalesce(F.get(F.reverse(s["open"]), F.lit(0))["at"], F.lit(-1)).alias("parent"), (F.size(s["open"]) + 1).alias("depth"), token.alias("token"))
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(tag & closes, left).when(tag & ~alone, pushed).otherwise(s["open"]).cast(stack).alias("open"),
            F.when(tag & closes, s["out"]).otherwise(F.concat(s["out"], F.array(row))).cast(out).alias("out"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def nodes(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, at, until, parent, depth, name, raw, attrs, text): elements (name in lower case; raw as written) and texts
    (name null) of each body, ``at`` and ``until`` the places of their first and last token and ``parent`` the enclosing element's
    (-1: none). An element without an end tag ends before what follows its last child. Comments are left out, CDATA is text.
    A body with a tag that never ends (broken_at) has no rows, nor has a null or empty one."""
    cut = pages.select(*AT, tokens_of(F.col("body")).alias("tokens")).where(~F.array_contains("tokens", "<"))
    rows = cut.select(*AT, F.posexplode("tokens").alias("at", "token")).repartition(*AT)
    tag, closes, alone = _kinds(F.col("token"))
    rows = rows.withColumn("closes", tag & closes).withColumn("opens", tag & ~closes & ~alone)
    page = Window.partitionBy(*AT)
    level = F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(page.orderBy("at"))
    rows = rows.withColumn("depth", level + F.when(F.col("opens"), 0).otherwise(1))
    name = F.lower(F.regexp_extract("token", NAME, 1))
    pair = Window.partitionBy(*AT, "depth", F.col("opens") | F.col("closes")).orderBy("at")
    fits = F.when(F.col("opens"), F.lead("closes").over(pair) & (F.lead(name).over(pair) == name)).when(F.col("closes"), F.lag("opens").over(pair)).otherwise(True)
    ended = F.when(F.col("opens"), F.lead("at").over(pair)).otherwise(F.col("at"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("until", ended).withColumn("paired", F.bool_and("fits").over(page))

    plain = rows.where("paired and not closes")
    roles = F.array_compact(F.array(F.struct((F.col("depth") - 1).alias("under"), F.lit(True).alias("child")), F.when(F.col("opens"), F.struct(F.col("depth").alias("under"), F.lit(False).alias("child")))))
    both = plain.select(*AT, "at", "until", "depth", "token", F.inline(roles))
    above = Window.partitionBy(*AT, "under").orderBy("at", F.desc("child"))
    parent = F.last(F.when(~F.col("child"), F.col("at")), ignorenulls=True).over(above)
    found = both.withColumn("parent", F.coalesce(parent, F.lit(-1))).where("child").select(*AT, "at", "until", "parent", F.col("depth").cast("int").alias("depth"), "token")

    loose = rows.where("not paired").select(*AT).distinct()
    same = [cut[c].eqNullSafe(loose[c]) for c in AT]
    walked = cut.join(loose, same, "left_semi").select(*AT, F.size("tokens").alias("size"), _walked(F.col("tokens")).alias("out"))
    behind = lambda x, i: F.get(F.filter(F.slice("out", i + 2, F.size("out")), lambda y: y["depth"] <= x["depth"]), F.lit(0))["at"]
    row = lambda x, i: F.struct(x["at"].alias("at"), (F.coalesce(behind(x, i), F.col("size")) - 1).alias("until"), x["parent"].alias("parent"), x["depth"].alias("depth"), x["token"].alias("token"))
    walked = walked.select(*AT, F.inline(F.transform("out", row)))
    every = found.unionByName(walked.select(*found.columns))
    token = F.col("token")
    is_tag = token.rlike("^<[A-Za-z]")
    cdata = token.startswith("<![CDATA[")
    every = every.where(is_tag | cdata | ~token.startswith("<")).withColumn("pairs", attribute_pairs(token))
    text = F.when(cdata, F.substring(token, F.lit(10), F.length(token) - 12)).when(~is_tag, unescape(token))
    return every.select(
        *AT, "at", "until", "parent", "depth", F.when(is_tag, F.lower(F.regexp_extract(token, NAME, 1))).alias("name"), F.when(is_tag, F.regexp_extract(token, NAME, 1)).alias("raw"),
        F.when(is_tag, attributes(F.col("pairs"))).alias("attrs"), text.alias("text"),
    )
