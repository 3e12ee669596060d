"""Secret scans over a trigram inverted index. DataFrame functions only.

Each rule's regex yields a Boolean trigram query (trigrams.py): an OR over its alternatives of an AND over the
trigrams that every match of the alternative must contain. The index holds the postings
(trigram -> document) of the trigrams that some query names. Intersecting postings gives candidate
(document, rule) pairs, which the regex then verifies; rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``any_case``: look its trigrams up in lower case. ``keep_group`` and ``keep_least``: drop matches whose group is
    shorter."""

    kind: str
    regex: str
    any_case: bool = False
    keep_group: int = 0
    keep_least: int = 0

    def trigram_query(self) -> list[list[str]]:
        """OR of ANDs of trigrams; empty if some alternative has no mandatory trigram."""
        return trigram_query(self.regex, self.any_case)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The base kinds in their listed order, then the added kinds.
RULES = (
    Rule("assign", ASSIGN, True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/@]{1,64}@"),
)
BASE = ("assign", "access", "hex")


def query_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(kind, clause, trigram, needed, any_case): the Boolean queries as rows; as many as the rules name."""
    rows = [(r.kind, i, t, len(c), r.any_case) for r in rules for i, c in enumerate(r.trigram_query()) for t in c]
    return spark.createDataFrame(rows, "kind string, clause int, trigram string, needed int, any_case boolean")


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, any_case, doc_id) for the trigrams that the rules' queries name; ``docs``: (doc_id, text)."""
    named = sorted({(t, r.any_case) for r in rules for c in r.trigram_query() for t in c})
    lower = docs.select("doc_id", "text", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.col("low" if any_case else "text").contains(t), F.struct(F.lit(t).alias("trigram"), F.lit(any_case).alias("any_case"))) for t, any_case in named])
    return lower.select("doc_id", F.inline(F.array_compact(held))).select("trigram", "any_case", "doc_id").distinct()


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, kinds): documents in all postings of some clause of a rule."""
    named = index.join(F.broadcast(queries), ["trigram", "any_case"])
    met = named.groupBy("doc_id", "kind", "clause", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind) of the rule's kept matches: the pieces between matches and the matches
    have lengths whose running sum gives the places, in code points."""
    regex, least = rule.regex, rule.keep_least
    if rule.kind in ("hex", "access"):
        # A match is as long as its run of characters: failing matches can be left out by the regex itself.
        regex, least = rule.regex[:-1] + "{%d,}" % (least - (4 if rule.kind == "access" else 0)), 0
    pieces, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(regex), F.lit(rule.keep_group)) if least else found
    parts = F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("found"), kept.alias("kept")), lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["found"]).alias("size"), F.length(x["kept"]).alias("kept")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        keep = x["size"].isNotNull() & (x["kept"] >= least)
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, zero, step)["spans"]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans) for every input row; spans: array of (start, end, kind), by start, then rule order.

    Null text counts as empty; texts without secrets have an empty array; repeated rows and rows that
    share an id or have none are each scanned; an empty table gives an empty result; extra columns
    are ignored.
    """
    docs = df.select(df[id_col].alias("doc_id"), text_of(df, text_col).alias("text"))
    may = candidates(build_index(docs, rules), query_table(df.sparkSession, rules)).select(F.col("doc_id").alias("c_id"), "kinds")
    joined = docs.join(may.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    text, found = F.col("text"), []
    for rule in rules:
        is_near = F.array_contains("kinds", rule.kind) if rule.trigram_query() else F.lit(True)
        regex = r"[0-9a-f]{24}" if rule.kind == "hex" else rule.regex
        found.append(F.when(is_near & text.rlike(regex), spans_of(text, rule)).otherwise(none))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    keyed = F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("doc_id", spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``. Null and blank texts have no spans; repeated rows and nulls in other columns: see find_secrets."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Positions in DuckDB: running sums over the pieces between matches and the matches."""
    parts = []
    for i, r in enumerate(RULES):
        rx = r.regex.replace("'", "''")
        kept = f"regexp_extract_all(t, '{rx}', {r.keep_group})"
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.keep_least} AS least, string_split_regex(t, '{rx}') AS p, regexp_extract_all(t, '{rx}') AS f, {kept} AS g FROM d WHERE regexp_matches(t, '{rx}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
x AS (SELECT doc_id, rank, kind, least, unnest(range(1, len(f) + 1)) AS i, p, f, g FROM m),
s AS (
  SELECT doc_id, rank, kind, length(g[i]) >= least AS ok,
         sum(length(p[i])) OVER w + coalesce(sum(length(f[i])) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(f[i]) AS n
  FROM x WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i)
),
k AS (SELECT doc_id, rank, kind, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS line FROM s WHERE ok),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(line, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(line, ',' ORDER BY a, rank) AS spans FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP1_SQL = _sql()
