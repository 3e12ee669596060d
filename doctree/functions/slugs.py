"""Slugs of page titles, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
SUFFIX_DIGITS = 6
#: The hash that existing file names were made with (its offset is not the usual one).
HASH_OFFSET, HASH_PRIME = 1469598103934665603, 1099511628211


def slugify(title: Column, page_id: Column | None = None) -> Column:
    """Lower case, white space and _ to -, other signs dropped, runs of - joined, - trimmed; where nothing is
    left, page-<id>, or empty without an id."""
    s = F.regexp_replace(F.lower(title), WHITE, "-")
    s = F.regexp_replace(F.translate(s, "_", "-"), "[^a-z0-9-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    other = F.lit("") if page_id is None else F.when(F.coalesce(page_id, F.lit("")) == "", "").otherwise(F.concat(F.lit("page-"), page_id))
    return F.when(s == "", other).otherwise(s)


def strip_collision_suffix(slug: Column) -> Column:
    return F.regexp_replace(slug, r"(?s)^(.+)-[0-9]{6}\z", "$1")


def reverse_slugify(filename: Column) -> Column:
    """A title from a file name: without .md and collision suffix, words with their first letter upper-case."""
    base = strip_collision_suffix(F.regexp_replace(filename, r"\.md\z", ""))
    words = F.filter(F.split(F.translate(base, "-_", "  "), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def title_slugs_match(title: Column, slug: Column) -> Column:
    return slugify(title) == slug


def numeric_id(page_id: Column) -> Column:
    """The id as a number, null unless it is all digits and fits an unsigned 64-bit number."""
    n = F.when(page_id.rlike(r"^[0-9]{1,20}\z"), page_id).try_cast("decimal(20,0)")
    return F.when(n <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), n)


def page_id_order(page_id: Column) -> Column:
    """A sort key: numeric ids by number, then the others as text."""
    n = numeric_id(page_id)
    return F.struct(n.isNull().alias("is_text"), n.alias("n"), page_id.alias("id"))


def _text_suffix(ids: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if s is None:
            return None
        h = np.uint64(HASH_OFFSET)
        with np.errstate(over="ignore"):
            for b in s.encode():
                h = (h ^ np.uint64(b)) * np.uint64(HASH_PRIME)
        return f"{int(h) % 10**SUFFIX_DIGITS:0{SUFFIX_DIGITS}d}"

    return ids.map(one, na_action="ignore")


def collision_suffix(page_id: Column, text_ids: bool = True) -> Column:
    """The last six digits of a numeric id, zero-padded; six digits of a hash of any other id. With
    ``text_ids`` False all ids must be numeric, and the expression stays free of Python."""
    n = numeric_id(page_id)
    digits = F.lpad((n % 10**SUFFIX_DIGITS).cast("long").cast("string"), SUFFIX_DIGITS, "0")
    if not text_ids:
        return digits
    return F.coalesce(digits, F.pandas_udf(_text_suffix, "string")(F.when(n.isNull(), page_id)))
