"""Text shaping, escapes, fences and sidecar comments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks by which files on disk carry preserved markup and attributes.
NAMESPACE = "gfl"
FENCE_WIDTH = 76
ESCAPED = r"([\\`*_\[\]<>])"
UNESCAPED = r"\\([\\`*_{}\[\]()#+\-.!|~>])"


def pre_normalise(md: Column) -> Column:
    """Without byte order mark, with \\n line ends, and without blanks at line ends."""
    s = F.regexp_replace(F.regexp_replace(md, "^\ufeff", ""), "\r\n?", "\n")
    return F.regexp_replace(s, r"[ \t\x0B\f]+(?=\n|\z)", "")


def collapse_whitespace(s: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank, trimmed; a backslash and a blank is a hard break."""
    one = F.regexp_replace(F.regexp_replace(s, r"[ \t\n\r]+", " "), r"^[\p{Z}\t-\r\x{85}]+|[\p{Z}\t-\r\x{85}]+\z", "")
    return F.replace(one, F.lit("\\ "), F.lit("\\\n"))


def escape_inline_text(s: Column) -> Column:
    return F.regexp_replace(s, ESCAPED, r"\\$1")


def strip_backslash_escapes(s: Column) -> Column:
    return F.regexp_replace(s, UNESCAPED, "$1")


def _replace(s: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_escape(s: Column) -> Column:
    return _replace(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def xml_attr_escape(s: Column) -> Column:
    return _replace(xml_escape(s), ('"', "&quot;"))


def wrap_cdata(s: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), _replace(s, ("]]>", "]]]]><![CDATA[>")), F.lit("]]>"))


def url_query_escape(s: Column) -> Column:
    """Unreserved characters stay, a blank is +, other bytes are %XX."""
    return _replace(F.url_encode(s), ("*", "%2A"), ("%7E", "~"))


def strip_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]*\z", "$1")


def prefix_blockquote(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def indent_after_first(s: Column, by: str = "  ") -> Column:
    return F.array_join(F.transform(F.split(s, "\n"), lambda x, i: F.when((i == 0) | (x == ""), x).otherwise(F.concat(F.lit(by), x))), "\n")


def _open_line(namespace: str) -> str:
    return f"<!-- {namespace}:storage:block:v1:b64"


def encode_block_fence(xml: Column, namespace: str = NAMESPACE) -> Column:
    body = F.replace(F.base64(xml.cast("binary")), F.lit("\r\n"), F.lit("\n"))
    return F.concat(F.lit(_open_line(namespace) + "\n"), F.when(body == "", "").otherwise(F.concat(body, F.lit("\n"))), F.lit("-->"))


def _decode(body: Column) -> Column:
    return F.try_to_binary(F.when(body.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"), body), F.lit("base64")).cast("string")


def decode_block_fence(html: Column, namespace: str = NAMESPACE) -> Column:
    """The markup in a block fence, null if the text isn't one."""
    body = F.regexp_extract(html, rf"(?s)\A{_open_line(namespace)}[ \t]*\n((?:[^\n]*\n)*?)[ \t\r]*-->[ \t\r]*\n*\z", 1)
    is_fence = html.rlike(rf"(?s)\A{_open_line(namespace)}[ \t]*\n(?:[^\n]*\n)*?[ \t\r]*-->[ \t\r]*\n*\z")
    return F.when(is_fence, _decode(F.regexp_replace(body, r"[ \t\r\n]", "")))


def is_block_fence(s: Column, namespace: str = NAMESPACE) -> Column:
    return s.rlike(rf"\A[ \t]*{_open_line(namespace)}[ \t]*\n")


def encode_inline_fence(xml: Column, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f'<{namespace}-fence data-v1-b64="'), F.replace(F.base64(xml.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit('"/>'))


def _trimmed(s: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(s, r"\A[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+\z", "")


def decode_inline_fence(s: Column, namespace: str = NAMESPACE) -> Column:
    shape = rf'\A<{namespace}-fence data-v1-b64="([^"]*)"/>\z'
    return F.when(_trimmed(s).rlike(shape), _decode(F.regexp_extract(_trimmed(s), shape, 1)))


def is_inline_fence(s: Column, namespace: str = NAMESPACE) -> Column:
    return _trimmed(s).startswith(f'<{namespace}-fence data-v1-b64="')


def encode_meta(attrs: Column, namespace: str = NAMESPACE) -> Column:
    """A map as a comment with sorted keys; empty for an empty or null map."""
    pair = lambda e: F.concat(e["key"], F.lit('="'), _replace(e["value"], ("&", "&amp;"), ('"', "&quot;")), F.lit('"'))
    inner = F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), pair), " ")
    return F.when(F.coalesce(F.size(attrs), F.lit(0)) < 1, "").otherwise(F.concat(F.lit(f"<!--{namespace}:meta "), inner, F.lit("-->")))


def decode_meta(s: Column, namespace: str = NAMESPACE) -> Column:
    """The map in a sidecar comment; null if the text isn't one or holds no pair. The last of equal keys wins."""
    t = _trimmed(s)
    body = F.substring(t, len(namespace) + 11, 1 << 30)
    body = F.left(body, F.greatest(F.length(body) - 3, F.lit(0)))
    rx = r'([A-Za-z_][A-Za-z0-9_:.-]*)="([^"]*)"'
    keys, values = F.regexp_extract_all(body, F.lit(rx), F.lit(1)), F.regexp_extract_all(body, F.lit(rx), F.lit(2))
    last = F.filter(F.transform(keys, lambda k, i: F.when(~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k), i)), lambda i: i.isNotNull())
    plain = lambda v: _replace(v, ("&quot;", '"'), ("&amp;", "&"))
    found = F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(keys, i), plain(F.get(values, i)))))
    return F.when(t.startswith(f"<!--{namespace}:meta ") & t.endswith("-->") & (F.size(keys) > 0), found)


def is_meta(s: Column, namespace: str = NAMESPACE) -> Column:
    return _trimmed(s).startswith(f"<!--{namespace}:meta ") & _trimmed(s).endswith("-->")
