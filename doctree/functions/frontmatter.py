"""Front matter of managed Markdown files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that managed files carry.
PAGE_ID, VERSION = "confluence_page_id", "confluence_version"
EMPTY = "struct<page_id:string,version:int,extra:array<string>>"


def has_front_matter(md: Column) -> Column:
    return md.startswith("---\n") | md.startswith("---\r\n")


def front_matter(page_id: Column, version: Column, extra: Column | None = None) -> Column:
    extra = F.array().cast("array<string>") if extra is None else extra
    return F.struct(page_id.alias("page_id"), version.cast("int").alias("version"), extra.alias("extra"))


def is_empty_front_matter(fm: Column) -> Column:
    return (F.coalesce(fm["page_id"], F.lit("")) == "") & (F.coalesce(fm["version"], F.lit(0)) == 0) & (F.coalesce(F.size(fm["extra"]), F.lit(0)) < 1)


def apply_front_matter(fm: Column, body: Column) -> Column:
    """The block in its canonical form before the body; the body alone for an empty block."""
    quoted = F.replace(F.replace(fm["page_id"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    lines = F.concat(
        F.when(F.coalesce(fm["page_id"], F.lit("")) != "", F.array(F.concat(F.lit(f'{PAGE_ID}: "'), quoted, F.lit('"')))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(fm["version"], F.lit(0)) != 0, F.array(F.concat(F.lit(f"{VERSION}: "), fm["version"].cast("string")))).otherwise(F.array().cast("array<string>")),
        F.coalesce(fm["extra"], F.array().cast("array<string>")),
    )
    head = F.concat(F.lit("---\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"))
    return F.when(is_empty_front_matter(fm), body).otherwise(F.concat(head, F.when(body == "", "").otherwise(F.concat(F.lit("\n"), body))))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space that is cut off around keys and values.
_EDGES = r"\A[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+\z"
#: The short escapes of a quoted value.
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}
_CODES = r"x[0-7][0-9A-Fa-f]|[01][0-7]{2}|u(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}|U(?:0000(?![Dd][89A-Fa-f])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}"
_ESCAPE = rf'\\(?:[abfnrtv\\"]|{_CODES})'
_QUOTED = rf'\A"(?:[^"\\\n]|{_ESCAPE})*"\z'


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, _EDGES, "")


def _unquoted(value: Column) -> Column:
    """The value of a well-formed quoted string, piece by piece; other values as they are."""
    pieces = F.regexp_extract_all(F.substr(value, F.lit(2), F.length(value) - 2), F.lit(rf"{_ESCAPE}|[^\\]+"), F.lit(0))
    short = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def piece(x: Column) -> Column:
        octal = x.rlike(r"^\\[01]")
        code = F.lpad(F.when(octal, F.conv(F.substr(x, F.lit(2)), 8, 16)).otherwise(F.substr(x, F.lit(3))), 8, "0")
        is_code = octal | x.rlike(r"^\\[xuU]")
        plain = F.when(is_code, F.decode(F.unhex(code), "UTF-32")).otherwise(F.try_element_at(short, F.substr(x, F.lit(2))))
        return F.when(x.startswith("\\"), plain).otherwise(x)

    return F.when(value.rlike(_QUOTED), F.array_join(F.transform(pieces, piece), "")).otherwise(value)


def _fields(inner: Column, body: Column, closed: Column, whole: Column) -> Column:
    """struct(fm, body, error) of an opened block's lines."""
    lines = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n"))
    parted = F.transform(lines, lambda x: F.struct(
        F.when(x.contains(":"), _trimmed(F.substring_index(x, ":", 1))).otherwise("").alias("key"),
        _trimmed(F.regexp_replace(x, r"(?s)\A[^:]*:", "")).alias("value"), x.alias("line"),
    ))

    def read(parts: Column) -> Column:
        of = lambda name: F.transform(F.filter(parts, lambda x: x["key"] == name), lambda x: x["value"])
        ids, versions = of(PAGE_ID), of(VERSION)
        extra = F.transform(F.filter(parts, lambda x: ~x["key"].isin(PAGE_ID, VERSION)), lambda x: x["line"])
        is_quoted = lambda v: (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')
        number = lambda v: F.when(v.rlike(r"\A[+-]?[0-9]+\z"), v).try_cast("int")
        bad = ~closed | F.exists(ids, lambda v: is_quoted(v) & ~v.rlike(_QUOTED)) | F.exists(versions, lambda v: number(v).isNull())
        page_id = F.coalesce(_unquoted(F.try_element_at(ids, F.lit(-1))), F.lit(""))
        version = F.coalesce(number(F.try_element_at(versions, F.lit(-1))), F.lit(0))
        fm = F.when(bad, front_matter(F.lit(""), F.lit(0))).otherwise(front_matter(page_id, version, extra))
        return F.struct(fm.alias("fm"), F.when(bad, whole).otherwise(body).alias("body"), bad.alias("error"))

    return _let(parted, read)


def extract_front_matter(md: Column) -> Column:
    """struct(fm, body, error). Without a block the body is the text. With an unclosed block, a version that
    isn't a number or a bad quoted id, error is set and the body is the whole text.

    Only the block at the top meets regular expressions line by line, and each part is worked out once.
    """
    shape = r"(?s)\A---\n(.*?)(?:(?<=\n))---(?:\n.*)?\z"

    def parts(s: Column) -> Column:
        def cut(block: Column) -> Column:
            # A closed block is opening, lines and closing; the lines between end with a line feed or are none.
            closed = s.rlike(shape)
            rest = F.substr(s, F.length(block) + 9)  # after both marks and the line feed
            return _fields(F.regexp_replace(block, r"\n+\z", ""), F.regexp_replace(rest, r"\A\n+", ""), closed, md)

        plain = F.struct(front_matter(F.lit(""), F.lit(0)).alias("fm"), s.alias("body"), F.lit(False).alias("error"))
        return F.when(s.startswith("---\n"), _let(F.regexp_extract(s, shape, 1), cut)).otherwise(plain)

    return _let(F.regexp_replace(F.regexp_replace(md, "^\ufeff", ""), "\r\n", "\n"), parts)
