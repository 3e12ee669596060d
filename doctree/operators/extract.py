"""Tables of what page bodies hold: constructs, blocks, links, images, table cells, tasks, panels and fences.

``pages``: scope_id, page_id (together a key), body (storage markup). All but the census and the fences come from the rows of
nodes.py: elements with their parents, so nested elements are whole, an element without an end tag ends with its parent, and
markup inside CDATA is text. One row a construct comes out, in the body's order. A body with a tag that never ends has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions import text as tx
from doctree.functions.tables import in_slices, work_table
from doctree.operators.nodes import AT, nodes, tokens_of, unescape

#: The macros that become admonitions, and their labels; the panel types of the newer form.
PANELS = {"info": "INFO", "tip": "SUCCESS", "note": "WARNING", "warning": "ERROR", "panel": "PANEL", "expand": "EXPAND"}
ADF_PANELS = {"info": "INFO", "note": "NOTE", "success": "SUCCESS", "warning": "WARNING", "error": "ERROR"}
NATIVE = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "hr", "pre", "ul", "ol", "li", "blockquote", "table", "thead", "tbody", "tr", "th", "td", "strong", "b", "em", "i", "s", "del", "strike", "code", "br", "a", "ac:link", "ac:image", "ac:task-list", "ac:task"]
WRAPPERS = ["ac:layout", "ac:layout-section", "ac:layout-cell", "span", "div", "u", "sub", "sup"]
PARTS = ["ri:page", "ri:attachment", "ri:url", "ri:user", "ac:parameter", "ac:rich-text-body", "ac:plain-text-body", "ac:link-body", "ac:plain-text-link-body", "ac:task-id", "ac:task-status", "ac:task-body", "ac:caption", "col", "colgroup"]
#: Elements whose own text stands as a paragraph.
HOLDERS = ["ac:layout", "ac:layout-section", "ac:layout-cell", "ac:rich-text-body", "ac:adf-content"]
#: How rows of bodies are joined: by sorting. A table of short repeated values, or one that long bodies are made from, has files far smaller than
#: its rows, so Spark would take it for small and send all of it through the driver's memory to every task.
BY_SORT = "merge"
TAG = r"""</?[A-Za-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def plain_text(markup: Column) -> Column:
    """The text without tags and comments; CDATA is text; white space joined."""
    cdata = F.regexp_extract_all(markup, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), F.lit(1))
    escaped = F.transform(cdata, tx.xml_escape)
    parts = F.split(markup, r"(?s)<!\[CDATA\[.*?\]\]>", -1)
    joined = F.array_join(F.zip_with(parts, escaped, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    bare = F.regexp_replace(joined, rf"(?s)<!--.*?-->|{TAG}|<[^<>]*>", "")
    return F.trim(F.regexp_replace(unescape(bare), r"[ \t\r\n\u00a0]+", " "))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in quotes of either kind, null if it has none."""
    rx = rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.when(tag.rlike(rx), unescape(F.concat(F.regexp_extract(tag, rx, 1), F.regexp_extract(tag, rx, 2))))


def _same(a: DataFrame, b: DataFrame, at: str | None = None, other: str | None = None) -> list[Column]:
    """Rows of one page, whose keys may be null; and a place in a that is a place in b."""
    return [a[c].eqNullSafe(b[c]) for c in AT] + ([a[at] == b[other]] if at else [])


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy(*AT).orderBy("at")) - 1)


def _outermost(found: DataFrame) -> DataFrame:
    """Elements inside no other of the table."""
    before = Window.partitionBy(*AT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("until").over(before), F.lit(-1))
    return found.withColumn("reach", reach).where(F.col("reach") < F.col("at")).drop("reach")


def _with_inner(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``inner``, the markup of the tokens behind ``at`` up to ``until`` (an end tag among them); made for the rows that are left only."""
    cut = pages.select(*AT, tokens_of(F.col("body")).alias("tokens"))
    inner = F.array_join(F.slice("tokens", F.col("at") + 2, F.greatest(F.col("until") - F.col("at"), F.lit(0))), "")
    return found.join(cut.hint(BY_SORT), _same(found, cut)).select(*[found[c] for c in found.columns], inner.alias("inner"))


def _own_texts(found: DataFrame) -> DataFrame:
    """(scope_id, page_id, owner, own): the texts right inside each element, trimmed."""
    texts = found.where("name is null").groupBy(*AT, F.col("parent").alias("owner")).agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return texts.select(*AT, "owner", F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("own"))


def _kids(found: DataFrame, condition: Column, value: Column) -> DataFrame:
    """(scope_id, page_id, owner, kid): ``value`` of the first element right inside each that meets the condition."""
    return found.where(condition).groupBy(*AT, F.col("parent").alias("owner")).agg(F.min_by(value, "at").alias("kid"))


def _attr(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def shown_text(markup: Column) -> Column:
    """The plain text without parameters of macros, attributes and fallbacks of the newer form, task ids and task states, which
    are not shown as text."""
    rx = r"(?s)(<!\[CDATA\[.*?\]\]>)|<(ac:parameter|ac:adf-attribute|ac:task-id|ac:task-status)\b[^<>]*>[^<]*</\2>|<ac:adf-fallback\b[^<>]*>.*?</ac:adf-fallback>"
    return plain_text(F.regexp_replace(markup, rx, "$1"))


def _each(pages: DataFrame, pattern: str, name: str) -> DataFrame:
    """One row a match of the pattern in a body: ordinal (from 0) and the match."""
    return pages.select(*AT, F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("ordinal", name))


def construct_census(pages: DataFrame) -> DataFrame:
    """(scope_id, construct, handling, n): opening tags by name (macros by their own), and what a conversion does with them."""
    tags = _each(pages, r"<[A-Za-z][^<>]*>", "tag")
    element = F.lower(F.regexp_extract("tag", r"^<([A-Za-z][A-Za-z0-9:-]*)", 1))
    macro = attribute(F.col("tag"), "ac:name")
    rows = tags.select("scope_id", element.alias("element"), F.when(element == "ac:structured-macro", macro).alias("macro"))
    handling = (
        F.when(F.col("macro").isin(*PANELS), "admonition").when(F.col("macro") == "code", "native").when(F.col("macro") == "toc", "dropped").when(F.col("macro").isNotNull(), "block_fence")
        .when(F.col("element").isin(*NATIVE), "native").when(F.col("element").isin(*WRAPPERS, *PARTS), "part").when(F.col("element") == "ac:emoticon", "inline_fence").otherwise("block_fence")
    )
    return rows.select("scope_id", F.coalesce(F.concat(F.lit("macro:"), "macro"), "element").alias("construct"), handling.alias("handling")).groupBy("scope_id", "construct", "handling").agg(F.count(F.lit(1)).alias("n"))


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, kind, level, lang, text) of headings, paragraphs, code, lists, quotes, tables, rules, images;
    a block inside another is part of its text. Text that stands alone, in the body, a layout or a panel, is a paragraph. Bodies are
    read in slices, so that rows of nodes are on disk for one slice at a time."""
    return in_slices(pages.select(*AT, "body"), AT, "bodies", _blocks)


def _blocks(pages: DataFrame) -> DataFrame:
    headings = [f"h{i}" for i in range(1, 7)]
    names = [*headings, "p", "pre", "ul", "ol", "blockquote", "table", "hr", "ac:image"]
    found = work_table(nodes(pages), "nodes")
    name = F.col("name")
    is_code = (name == "ac:structured-macro") & _attr(F.col("attrs"), "ac:name").eqNullSafe("code")
    holders = found.where(name.isin(*HOLDERS)).select(*AT, F.col("at").alias("holder"))
    texts = found.where(name.isNull() & (F.trim(F.regexp_replace("text", r"[\s\x{85}\p{Z}]+", " ")) != ""))
    alone = texts.join(holders.hint(BY_SORT), _same(texts, holders, "parent", "holder"), "left_semi").unionByName(texts.where("parent = -1"))
    # What the newer form falls back to is not shown: it is met like a block, so that nothing inside is, and left out.
    tops = _outermost(found.where(name.isin(*names, "ac:adf-fallback") | is_code).unionByName(alone))
    blocks = _numbered(tops.where(name.isNull() | (name != "ac:adf-fallback")))
    blocks = work_table(_with_inner(blocks, pages), "blocks")
    inner, is_macro, heading = F.col("inner"), name == "ac:structured-macro", name.isin(headings)
    own = _own_texts(found)
    params = found.where((name == "ac:parameter") & (_attr(F.col("attrs"), "ac:name") == "language"))
    params = params.join(own.hint(BY_SORT), _same(params, own, "at", "owner")).select(*[params[c] for c in AT], F.col("parent").alias("macro"), F.lower(F.nullif("own", F.lit(""))).alias("lang"))
    blocks = blocks.join(params.dropDuplicates([*AT, "macro"]).hint(BY_SORT), _same(blocks, params, "at", "macro"), "left").select(*[blocks[c] for c in blocks.columns], "lang")
    kind = F.when(heading, "heading").when(name.isNull() | (name == "p"), "para").when(is_macro | (name == "pre"), "code").when(name.isin("ul", "ol"), "list").when(name == "blockquote", "quote").when(name == "hr", "hr").when(name == "ac:image", "image").otherwise("table")
    body = F.when(is_macro, F.regexp_extract(inner, r"(?s)<ac:plain-text-body>(.*)</ac:plain-text-body>", 1)).otherwise(inner)
    text = F.when(name.isNull(), F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))).otherwise(plain_text(body))
    return blocks.select(*AT, "ordinal", kind.alias("kind"), F.when(heading, F.substring(name, 2, 1).cast("int")).alias("level"), F.when(is_macro, F.col("lang")).alias("lang"), text.alias("text"))


def extract_links(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, kind, href, content_id, title, space, text): external, page, attachment, user, other; a link inside
    another is part of its text."""
    found = work_table(nodes(pages), "nodes")
    links = _numbered(_outermost(found.where(F.col("name").isin("a", "ac:link"))))
    parts = found.where("name like 'ri:%'").select(*AT, "parent", "at", "name", "attrs")
    page = _kids(parts, F.col("name") == "ri:page", F.col("attrs")).withColumnRenamed("kid", "page")
    target = _kids(parts, F.lit(True), F.col("name")).withColumnRenamed("kid", "target")
    links = _with_inner(links, pages)
    links = links.join(page.hint(BY_SORT), _same(links, page, "at", "owner"), "left").select(*[links[c] for c in links.columns], "page")
    links = links.join(target.hint(BY_SORT), _same(links, target, "at", "owner"), "left").select(*[links[c] for c in links.columns], "target")
    href = F.when(F.col("name") == "a", _attr(F.col("attrs"), "href"))
    kind = F.when(href.isNotNull(), "external").when((F.col("name") == "ac:link") & F.col("page").isNotNull(), "page").when(F.col("target") == "ri:attachment", "attachment").when(F.col("target") == "ri:user", "user").otherwise("other")
    of = lambda key: F.when(F.col("name") == "ac:link", _attr(F.col("page"), key))
    return links.select(*AT, "ordinal", kind.alias("kind"), href.alias("href"), of("ri:content-id").alias("content_id"), of("ri:content-title").alias("title"), of("ri:space-key").alias("space"), plain_text(F.col("inner")).alias("text"))


def extract_images(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, filename, url, alt, attrs): attrs are the other attributes of the image."""
    found = work_table(nodes(pages).where("name = 'ac:image' or name in ('ri:attachment', 'ri:url')"), "nodes")
    images = _numbered(found.where("name = 'ac:image'").select(*AT, "at", "attrs"))
    file = _kids(found, F.col("name") == "ri:attachment", _attr(F.col("attrs"), "ri:filename")).withColumnRenamed("kid", "filename")
    url = _kids(found, F.col("name") == "ri:url", _attr(F.col("attrs"), "ri:value")).withColumnRenamed("kid", "url")
    images = images.join(file.hint(BY_SORT), _same(images, file, "at", "owner"), "left").select(*[images[c] for c in images.columns], "filename")
    images = images.join(url.hint(BY_SORT), _same(images, url, "at", "owner"), "left").select(*[images[c] for c in images.columns], "url")
    kept = F.map_filter("attrs", lambda k, v: ~k.isin("ac:alt", "ac:macro-id", "ac:local-id"))
    return images.select(*AT, "ordinal", "filename", "url", F.coalesce(_attr(F.col("attrs"), "ac:alt"), tx.strip_ext(F.col("filename")), F.lit("")).alias("alt"), kept.alias("attrs"))


def extract_tables(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, row, col, header, align, text): cells of all tables, rows of the head first, cut or filled to the
    first row's width. A table inside a cell is a table of its own, and its text is part of that cell's."""
    found = work_table(nodes(pages).where(F.col("name").isin("table", "thead", "tbody", "tfoot", "tr", "th", "td")).select(*AT, "at", "until", "parent", "name", "attrs"), "nodes")
    of = lambda names, *columns: found.where(F.col("name").isin(*names)).select(*AT, *columns)
    tables = _numbered(of(["table"], "at")).withColumnRenamed("at", "table_at")
    parts = of(["thead", "tbody", "tfoot"], F.col("at").alias("part_at"), F.col("parent").alias("part_of"), (F.col("name") == "thead").alias("head"))
    rows = of(["tr"], F.col("at").alias("row_at"), "parent")
    rows = rows.join(parts.hint(BY_SORT), _same(rows, parts, "parent", "part_at"), "left").select(*[rows[c] for c in AT], "row_at", F.coalesce("part_of", "parent").alias("of"), F.coalesce("head", F.lit(False)).alias("head"))
    rows = rows.join(tables.hint(BY_SORT), _same(rows, tables, "of", "table_at")).select(*[rows[c] for c in AT], "ordinal", "row_at", "head")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy(*AT, "ordinal").orderBy(F.desc("head"), "row_at")) - 1)
    cells = of(["th", "td"], "at", "until", F.col("parent").alias("in_row"), F.regexp_extract(F.coalesce(_attr(F.col("attrs"), "style"), F.lit("")), r"text-align:\s*([a-z]+)", 1).alias("align"))
    cells = cells.withColumn("col", F.row_number().over(Window.partitionBy(*AT, "in_row").orderBy("at")) - 1)
    wide = cells.groupBy(*AT, "in_row").agg(F.count(F.lit(1)).cast("int").alias("cells"))
    sized = rows.join(wide.hint(BY_SORT), _same(rows, wide, "row_at", "in_row"), "left").select(*[rows[c] for c in rows.columns], F.coalesce("cells", F.lit(0)).alias("cells"))
    width = F.max(F.when(F.col("row") == 0, F.col("cells"))).over(Window.partitionBy(*AT, "ordinal"))
    grid = sized.withColumn("width", width).where("width > 0").select(*AT, "ordinal", "row", "row_at", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("place"))
    told = _with_inner(cells, pages).select(*AT, "in_row", "col", F.nullif("align", F.lit("")).alias("align"), plain_text(F.col("inner")).alias("text"))
    both = grid.join(told.hint(BY_SORT), [*_same(grid, told, "row_at", "in_row"), grid["place"] == told["col"]], "left")
    return both.select(*[grid[c] for c in AT], "ordinal", "row", F.col("place").alias("col"), (F.col("row") == 0).alias("header"), "align", F.coalesce("text", F.lit("")).alias("text"))


def extract_tasks(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, done, text): tasks, those inside others too; a task's text holds theirs."""
    found = work_table(nodes(pages), "nodes")
    tasks = _numbered(found.where("name = 'ac:task'").select(*AT, "at"))
    own = _own_texts(found)
    states = found.where("name = 'ac:task-status'").select(*AT, "at", "parent")
    states = states.join(own.hint(BY_SORT), _same(states, own, "at", "owner")).select(*[states[c] for c in AT], "at", "parent", "own")
    state = _kids(states, F.lit(True), F.col("own")).withColumnRenamed("kid", "state")
    bodies = found.where("name = 'ac:task-body'").select(*AT, "at", "until", "parent")
    bodies = _with_inner(bodies, pages).groupBy(*AT, F.col("parent").alias("owner")).agg(F.min_by(shown_text(F.col("inner")), "at").alias("text"))
    tasks = tasks.join(state.hint(BY_SORT), _same(tasks, state, "at", "owner"), "left").select(*[tasks[c] for c in tasks.columns], "state")
    tasks = tasks.join(bodies.hint(BY_SORT), _same(tasks, bodies, "at", "owner"), "left").select(*[tasks[c] for c in tasks.columns], "text")
    return tasks.select(*AT, "ordinal", F.coalesce(F.col("state") == "complete", F.lit(False)).alias("done"), F.coalesce("text", F.lit("")).alias("text"))


def extract_panels(pages: DataFrame) -> DataFrame:
    """(scope_id, page_id, ordinal, label, title, state, meta, text) of macros, panels of the newer form and decisions that become
    admonitions, those inside others too; a panel's text holds theirs. ``meta``: parameters and data-* attributes, of a decision
    its state unless DECIDED. A parameter or attribute belongs to its nearest enclosing macro or node."""
    found = work_table(nodes(pages), "nodes")
    name, attrs = F.col("name"), F.col("attrs")
    labels = lambda of, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key)
    own = _own_texts(found)
    params = found.where(name.isin("ac:parameter", "ac:adf-attribute")).select(*AT, "at", "parent", F.coalesce(_attr(attrs, "ac:name"), _attr(attrs, "key"), F.lit("")).alias("k"))
    params = params.join(own.hint(BY_SORT), _same(params, own, "at", "owner"), "left").select(*[params[c] for c in params.columns], F.coalesce("own", F.lit("")).alias("v")).where("k <> ''")
    params = params.groupBy(*AT, "parent", "k").agg(F.max_by("v", "at").alias("v")).groupBy(*AT, F.col("parent").alias("owner")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("params"))
    bodies = found.where(name.isin("ac:rich-text-body", "ac:adf-content")).select(*AT, "at", "until", "parent")
    bodies = _with_inner(bodies, pages).groupBy(*AT, F.col("parent").alias("owner")).agg(F.min_by(shown_text(F.col("inner")), "at").alias("text"))
    owners = found.where(name.isin("ac:structured-macro", "ac:adf-node")).select(*AT, "at", "name", "attrs")
    owners = owners.join(params.hint(BY_SORT), _same(owners, params, "at", "owner"), "left").select(*[owners[c] for c in owners.columns], F.coalesce("params", F.expr("map()").cast("map<string,string>")).alias("params"))
    owners = owners.join(bodies.hint(BY_SORT), _same(owners, bodies, "at", "owner"), "left").select(*[owners[c] for c in owners.columns], F.coalesce("text", F.lit("")).alias("text"))
    kind, macro = _attr(attrs, "type"), name == "ac:structured-macro"
    label = F.when(macro, labels(PANELS, _attr(attrs, "ac:name"))).when(kind == "panel", labels(ADF_PANELS, _attr(F.col("params"), "panel-type"))).when(kind == "decision-item", "DECISION")
    state = F.when(label == "DECISION", _attr(F.col("params"), "state"))
    data = F.map_filter("attrs", lambda k, v: k.startswith("data-") & ~F.array_contains(F.map_keys("params"), k))
    meta = F.when(macro, F.map_concat("params", data)).when(F.coalesce(state, F.lit("")).isin("", "DECIDED"), F.expr("map()").cast("map<string,string>")).otherwise(F.create_map(F.lit("state"), state))
    panels = _numbered(owners.withColumn("label", label).where("label is not null"))
    return panels.select(*AT, "ordinal", "label", F.when(macro, F.nullif(_attr(F.col("params"), "title"), F.lit(""))).alias("title"), state.alias("state"), meta.alias("meta"), "text")


def extract_fences(files: DataFrame) -> DataFrame:
    """files (scope_id, path, content) -> (scope_id, path, ordinal, kind, xml): preserved markup in Markdown."""
    ns = tx.NAMESPACE
    rx = rf'(?s)<!-- {ns}:storage:block:v1:b64[ \t]*\n(?:[A-Za-z0-9+/= \t\r]*\n)*?[ \t]*-->|<{ns}-fence data-v1-b64="[^"]*"/>'
    rows = files.select("scope_id", "path", F.posexplode(F.regexp_extract_all("content", F.lit(rx), F.lit(0))).alias("ordinal", "fence"))
    is_block = F.col("fence").startswith("<!--")
    return rows.select("scope_id", "path", "ordinal", F.when(is_block, "block").otherwise("inline").alias("kind"), F.when(is_block, tx.decode_block_fence(F.col("fence"))).otherwise(tx.decode_inline_fence(F.col("fence"))).alias("xml"))
