import posixpath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doctree.functions import frontmatter as fm
from doctree.functions import paths as ps
from doctree.functions import slugs as sl
from doctree.functions import text as tx

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def plain_slug(title, page_id):
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789-" else "-" if c == "_" or c.isspace() else "" for c in title.lower())
    slug = "-".join(p for p in kept.split("-") if p)
    return slug or (f"page-{page_id}" if page_id else "")


def test_slugify(column):
    titles = ["Rye & Barley: 3 loaves", "ζύμη", "", "oven_door\t hinge", "-_- mill -_-", "Crème brûlée", "12 / 24 h proof", "flour\u00a0store", "..."]
    cases = [(t, i) for t in titles for i in ("", "88")]
    assert column(cases, "t string, i string", sl.slugify(F.col("t"), F.col("i"))) == [plain_slug(t, i) for t, i in cases]


@FEW
@given(st.lists(st.text(alphabet="aZ09 _-.\té☃", max_size=12), min_size=5, max_size=40))
def test_slugs_follow_the_rule_and_stay(spark, titles):
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", sl.slugify(F.col("t"), F.lit("7")).alias("s"))
    for r in rows.select("t", "s", sl.slugify(F.col("s"), F.lit("7")).alias("again")).collect():
        assert r["s"] == plain_slug(r["t"], "7") == r["again"]


def test_reverse_slugify(column):
    cases = [("sourdough-starter-200311.md", "Sourdough Starter"), ("batch-20031.md", "Batch 20031"), ("rye_mix-2.md", "Rye Mix 2"), ("pH-log", "PH Log"), ("200311.md", "200311"), ("a-2003112.md", "A 2003112")]
    assert column([c[:1] for c in cases], "f string", sl.reverse_slugify(F.col("f"))) == [c[1] for c in cases]


def test_collision_suffix(column):
    got = column([("90210000417",), ("31",), ("loaf",)], "i string", sl.collision_suffix(F.col("i")))
    h = 1469598103934665603
    for b in b"loaf":
        h = ((h ^ b) * 1099511628211) % 2**64
    assert got == ["000417", "000031", f"{h % 10**6:06d}"]


def test_rel_path_and_join_are_inverse(column):
    cases = [("bakery/ovens", "bakery/yeast.md", "../yeast.md"), ("bakery", "bakery/rye/old.md", "rye/old.md"), ("m/n", "m/n", "."), ("m", "m/n/../o", "n/../o"), (".", "k/l.md", "k/l.md")]
    assert column([c[:2] for c in cases], "d string, t string", ps.rel_path(F.col("d"), F.col("t"))) == [c[2] for c in cases]
    joins = [("bakery/rye", "../mill.md", "bakery/mill.md"), ("", "p//q/./r", "p/q/r"), ("m", "../../n", "../n"), ("m", "..", ".")]
    assert column([c[:2] for c in joins], "d string, t string", ps.join_clean(F.col("d"), F.col("t"))) == [c[2] for c in joins]


@FEW
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.lists(st.sampled_from("abc"), min_size=1, max_size=4)), min_size=5, max_size=40))
def test_rel_path_matches_the_library(spark, pairs):
    rows = [("/".join(a), "/".join(b)) for a, b in pairs]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ps.rel_path(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == posixpath.relpath(r["b"], r["a"]) for r in got)


def test_attachment_paths(column):
    root, files = F.lit("bakery/"), F.lit("bakery/_pictures")

    def plain_dir(path):
        rest = path.removeprefix("bakery/").removesuffix(".md")
        rest = "" if rest == "index" else rest.removesuffix("/index")
        return "bakery/_pictures" + (f"/{rest}" if rest else "")

    pages = ["bakery/rye/index.md", "bakery/rye.md", "bakery/index.md", "bakery/rye/dark/crust.md"]
    assert column([(x,) for x in pages], "p string", ps.attachment_dir(F.col("p"), root, files)) == [plain_dir(x) for x in pages]
    assert plain_dir(pages[0]) == plain_dir(pages[1]) == "bakery/_pictures/rye"
    want = [posixpath.relpath(f"{plain_dir(x)}/crumb.jpg", posixpath.dirname(x)) for x in pages]
    assert column([(x,) for x in pages], "p string", ps.attachment_src(F.col("p"), F.lit("crumb.jpg"), root, files)) == want
    srcs = [("bakery/rye.md", "_pictures/rye/k.jpg", "bakery/_pictures/rye/k.jpg"), ("bakery/rye.md", "bakery/_pictures/k.jpg", "bakery/_pictures/k.jpg"), ("bakery/rye.md", "elsewhere.jpg", None), ("bakery/rye.md", "", None)]
    assert column([c[:2] for c in srcs], "p string, s string", ps.canonical_attachment_path(F.col("p"), F.col("s"), files)) == [c[2] for c in srcs]


def test_front_matter(column):
    md = '---\nconfluence_page_id: "311"\nconfluence_version: 12\noven: 3\n---\n\nKnead twice.\n'
    cases = [
        (md, ("311", 12, ["oven: 3"], "Knead twice.\n", False)),
        (md.replace("\n", "\r\n"), ("311", 12, ["oven: 3"], "Knead twice.\n", False)),
        ("no block\n", ("", 0, [], "no block\n", False)),
        ("---\nopen\n", ("", 0, [], "---\nopen\n", True)),
        ("---\nconfluence_version: x\n---\nb", ("", 0, [], "---\nconfluence_version: x\n---\nb", True)),
        ("---\n---\nbody", ("", 0, [], "body", False)),
        ("---\nconfluence_page_id: 5\nconfluence_page_id: 6\n\nz\n---\n", ("6", 0, ["", "z"], "", False)),
    ]
    got = column([c[:1] for c in cases], "m string", fm.extract_front_matter(F.col("m")))
    assert [(g["fm"]["page_id"], g["fm"]["version"], g["fm"]["extra"], g["body"], g["error"]) for g in got] == [c[1] for c in cases]
    x = fm.extract_front_matter(F.col("m"))
    assert column([(md,)], "m string", fm.apply_front_matter(x["fm"], x["body"])) == [md]
    assert column([("x\n",)], "m string", fm.apply_front_matter(fm.extract_front_matter(F.col("m"))["fm"], F.col("m"))) == ["x\n"]


@FEW
@given(st.lists(st.text(max_size=120), min_size=3, max_size=12))
def test_fences_round_trip(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select("x", tx.encode_block_fence(F.col("x")).alias("b"), tx.encode_inline_fence(F.col("x")).alias("i"))
    back = rows.select("x", "b", "i", tx.decode_block_fence(F.col("b")).alias("xb"), tx.decode_inline_fence(F.col("i")).alias("xi"), tx.is_block_fence(F.col("b")).alias("is_b")).collect()
    for r in back:
        assert r["xb"] == r["x"] == r["xi"] and r["is_b"] and "\n" not in r["i"]
        assert max(map(len, r["b"].split("\n")[1:-1]), default=0) <= 76


def test_fence_shapes(column):
    bad = [("<!-- other -->",), ("<!-- gfl:storage:block:v1:b64\n!!\n-->",), ("text",)]
    assert column(bad, "x string", tx.decode_block_fence(F.col("x"))) == [None, None, None]
    loose = "<!-- gfl:storage:block:v1:b64  \nPHA+\n eDwvcD4=\n -->\n\n"
    assert column([(loose,)], "x string", tx.decode_block_fence(F.col("x"))) == ["<p>x</p>"]


def test_meta(column):
    got = column([({"ac:width": "640", "ac:align": 'm"&'},), ({},), (None,)], "m map<string,string>", tx.encode_meta(F.col("m")))
    assert got == ['<!--gfl:meta ac:align="m&quot;&amp;" ac:width="640"-->', "", ""]
    back = column([(got[0],), ('<!--gfl:meta a="1" a="2"-->',), ("<!-- x -->",)], "s string", tx.decode_meta(F.col("s")))
    assert back == [{"ac:align": 'm"&', "ac:width": "640"}, {"a": "2"}, None]


def test_text(column):
    assert column([("﻿a \r\nb\t\rc  ",)], "s string", tx.pre_normalise(F.col("s"))) == ["a\nb\nc"]
    assert column([("  a \n b\\\n c ",)], "s string", tx.collapse_whitespace(F.col("s"))) == ["a b\\\nc"]
    raw = r"a*b_[c]\<d>`"
    assert column([(raw,)], "s string", tx.strip_backslash_escapes(F.replace(tx.escape_inline_text(F.col("s")), F.lit("\\<"), F.lit("<")))) == [raw]
    assert column([("x]]>y",)], "s string", tx.wrap_cdata(F.col("s"))) == ["<![CDATA[x]]]]><![CDATA[>y]]>"]
    assert column([("a b~*é",)], "s string", tx.url_query_escape(F.col("s"))) == ["a+b~%2A%C3%A9"]
    assert column([("a\n\nb",)], "s string", tx.prefix_blockquote(F.col("s"))) == ["> a\n>\n> b"]


def test_escapes_and_white_space_around_sidecars(column):
    quoted = [(r"\101\x42\u00e9\U0001F600\n\"", 'AB\u00e9\U0001F600\n"'), (r"\400", None), (r"\ud800", None), (r"\U00110000", None), (r"\q", None)]
    got = column([(f'---\nconfluence_page_id: "{q}"\n---\n',) for q, _ in quoted], "m string", fm.extract_front_matter(F.col("m")))
    assert [None if g["error"] else g["fm"]["page_id"] for g in got] == [v for _, v in quoted]
    around = [("\n\t<!--gfl:meta k=\"v\"-->\u00a0\r\n",), (" <!--gfl:meta k=\"v\"-->",)]
    assert column(around, "s string", tx.decode_meta(F.col("s"))) == [{"k": "v"}] * 2 and column(around, "s string", tx.is_meta(F.col("s"))) == [True, True]
    fence = [("\n\t<gfl-fence data-v1-b64=\"PHA+\"/>\n",)]
    assert column(fence, "s string", tx.decode_inline_fence(F.col("s"))) == ["<p>"] and column(fence, "s string", tx.is_inline_fence(F.col("s"))) == [True]


def test_rows_are_numbered_under_a_null_key_too(spark):
    from doctree.functions.tables import numbered

    rows = spark.createDataFrame([(None, n) for n in range(50)] + [("k", n) for n in range(7)], "k string, n long")
    assert sorted((r["k"] or "", r["n"], r["i"]) for r in numbered(rows, ["k"], ["n"], "i").collect()) == sorted([("", n, n + 1) for n in range(50)] + [("k", n, n + 1) for n in range(7)])
