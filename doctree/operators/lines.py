"""Line diffs and three-way line merges of many files at once: lines are rows, matches are joins.

A diff is a patience diff. Lines that one gap holds once on both sides are matched by an equi-join; of those, a longest
run that rises on both sides stays; the gaps between them then grow from both ends over equal lines, and what is left is
looked at again until nothing more is found. A line is what stands between line feeds; no other character ends it.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions.tables import work_table

FILE = ["scope_id", "path", "side"]
MATCH = "scope_id string, path string, side string, a long, b long"


def rising(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one file's pairs (a, b; each number once), a longest part that rises in both."""
    pairs = pairs.sort_values("a", ignore_index=True)
    if pairs["b"].is_monotonic_increasing:
        return pairs
    ends, at, before = [], [], []
    for n, b in enumerate(pairs["b"].tolist()):
        k = bisect_left(ends, b)
        ends[k:k + 1], at[k:k + 1] = [b], [n]
        before.append(at[k - 1] if k else -1)
    keep, n = [], at[-1]
    while n >= 0:
        keep.append(n)
        n = before[n]
    return pairs.iloc[keep[::-1]]


def _gaps(lines: DataFrame, matched: DataFrame, number: str) -> DataFrame:
    """The lines (FILE, n, line) that are not matched, with ``gap`` (matches before them), ``first`` and ``last`` (places from
    the gap's begin and end, from 0) and ``size``."""
    met = matched.select(*FILE, F.col(number).alias("n"), F.lit(1).alias("met"))
    before = Window.partitionBy(*FILE).orderBy("n")
    rows = lines.join(met, [*FILE, "n"], "left").withColumn("gap", F.count("met").over(before)).where("met is null")
    whole = Window.partitionBy(*FILE, "gap")
    rows = rows.withColumn("first", F.col("n") - F.min("n").over(whole)).withColumn("size", F.count(F.lit(1)).over(whole))
    return rows.select(*FILE, "n", "line", "gap", "first", (F.col("size") - 1 - F.col("first")).alias("last"), "size")


def _ends(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches at the begin and end of gaps: lines equal as far as all before (behind) them are."""
    def placed(d, n):
        places = F.array(F.struct(F.lit("first").alias("end"), F.col("first").alias("at")), F.struct(F.lit("last").alias("end"), F.col("last").alias("at")))
        return d.select(*FILE, "gap", F.col("n").alias(n), F.col("size").alias(f"{n}_size"), "line", F.inline(places))

    gap = [*FILE, "gap"]
    pairs = placed(a, "a").join(placed(b, "b"), [*gap, "end", "at", "line"])
    nth = F.row_number().over(Window.partitionBy(*gap, "end").orderBy("at")) - 1
    run = pairs.withColumn("nth", nth).where("nth = at")
    begin = F.coalesce(F.max(F.when(F.col("end") == "first", F.col("at") + 1)).over(Window.partitionBy(*gap)), F.lit(0))
    room = F.least("a_size", "b_size") - begin
    return run.withColumn("room", room).where((F.col("end") == "first") | (F.col("at") < F.col("room"))).select(*FILE, "a", "b")


def _anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches of lines that their gap holds once on both sides, in rising order."""
    once = lambda d, n: d.groupBy(*FILE, "gap", "line").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias(n)).where("times = 1").drop("times")
    pairs = once(a, "a").join(once(b, "b"), [*FILE, "gap", "line"]).select(*FILE, "a", "b")
    return pairs.groupBy(*FILE).applyInPandas(lambda key, pdf: rising(pdf), MATCH)


def matched_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scope_id, path, side, a, b): line numbers that belong together in the files of both tables (scope_id, path, side, n, line)."""
    found = work_table(a.sparkSession.createDataFrame([], MATCH), "matches")
    while True:
        here, there = _gaps(a, found, "a"), _gaps(b, found, "b")
        grown = work_table(found.unionByName(_ends(here, there)), "matches")
        here, there = _gaps(a, grown, "a"), _gaps(b, grown, "b")
        new = work_table(_anchors(here, there), "anchors")
        if new.isEmpty():
            return grown
        found = work_table(grown.unionByName(new), "matches")


def edits(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scope_id, path, side, i, j, lines): lines i to j (not j) of a become these in b; the edits of a file touch nowhere."""
    found = matched_lines(a, b)
    here, there = _gaps(a, found, "a"), _gaps(b, found, "b")
    gap = [*FILE, "gap"]
    gone = here.groupBy(*gap).agg(F.min("n").alias("i"), (F.max("n") + 1).alias("j"))
    came = there.groupBy(*gap).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    nth = F.row_number().over(Window.partitionBy(*FILE).orderBy("a"))
    begin = found.select(*FILE, nth.alias("gap"), (F.col("a") + 1).alias("begin"))  # the gap behind the n-th match
    both = gone.join(came, gap, "full_outer").join(begin, gap, "left")
    at = F.coalesce("i", "begin", F.lit(0))
    return both.select(*FILE, at.cast("long").alias("i"), F.coalesce("j", at).cast("long").alias("j"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def _lines(files: DataFrame, column: str, side: str) -> DataFrame:
    rows = files.select("scope_id", "path", F.lit(side).alias("side"), F.posexplode(F.split(F.col(column), "\n", -1)).alias("n", "line"))
    return rows.withColumn("n", F.col("n").cast("long"))


def merge_lines(files: DataFrame) -> DataFrame:
    """files (scope_id, path, b, o, t: a base and two texts made from it; a path once) -> (scope_id, path, outcome, content).

    merged: both sides' edits of the base, each once where both made the same one. conflict, content null: edits of both sides
    that differ and touch the same or neighbouring lines. An empty table gives an empty result.
    """
    files = work_table(files, "texts")
    at = ["scope_id", "path"]
    base = _lines(files, "b", "o").unionByName(_lines(files, "b", "t"))
    sides = _lines(files, "o", "o").unionByName(_lines(files, "t", "t"))
    base = work_table(base, "lines")
    made = work_table(edits(base, work_table(sides, "lines")).select(*at, "i", "j", "lines").distinct(), "edits")
    before = Window.partitionBy(*at).orderBy("i", "j", "lines").rowsBetween(Window.unboundedPreceding, -1)
    clash = made.withColumn("reach", F.max("j").over(before)).where("i <= reach").select(*at).distinct()
    good = made.join(clash, at, "left_anti")
    kept = base.where("side = 'o'").join(clash, at, "left_anti").select(*at, F.col("n").alias("i"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("j"), F.array("line").alias("lines"))
    rows = good.select(*at, "i", F.lit(0).alias("kind"), "j", "lines").unionByName(kept)
    so_far = Window.partitionBy(*at).orderBy("i", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reach", F.max("j").over(so_far)).where("kind = 0 or reach is null or i >= reach")
    parts = F.sort_array(F.collect_list(F.struct("i", "kind", "lines")))
    text = F.array_join(F.flatten(F.transform(parts, lambda x: x["lines"])), "\n")
    merged = rows.groupBy(*at).agg(text.alias("content")).select(*at, F.lit("merged").alias("outcome"), "content")
    return merged.unionByName(clash.select(*at, F.lit("conflict").alias("outcome"), F.lit(None).cast("string").alias("content")))
