import random

from doctree.operators import lines as ln
from doctree.operators import snapshots as sn

FILES = "scope_id string, path string, content string"
THREE = "scope_id string, path string, b string, o string, t string"


def patience(a, b, i=0, k=0):
    """Pairs of line numbers, by the rule of the module: ends first, then lines that are there once, again and again."""
    out = []
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        out.append((i + begin, k + begin))
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        out.append((i + len(a) - 1 - end, k + len(b) - 1 - end))
        end += 1
    a, b, i, k = a[begin : len(a) - end], b[begin : len(b) - end], i + begin, k + begin
    once = sorted((a.index(x), b.index(x)) for x in set(a) & set(b) if a.count(x) == b.count(x) == 1)
    best = [[]]
    for p in once:
        best.append(max((r for r in best if not r or r[-1][1] < p[1]), key=len) + [p])
    run = max(best, key=len)
    if run:
        out += [(i + x, k + y) for x, y in run]
        for (x, y), (u, v) in zip([(-1, -1), *run], [*run, (len(a), len(b))]):
            out += patience(a[x + 1 : u], b[y + 1 : v], i + x + 1, k + y + 1)
    return sorted(out)


def applied(a, made):
    out, at = [], 0
    for i, j, new in sorted(made):
        out += [*a[at:i], *new]
        at = j
    return out + a[at:]


def test_edits_lead_from_one_text_to_the_other(spark):
    r = random.Random(3)
    texts = {}
    for n in range(40):
        a = [r.choice("abcdefgh\f ") * r.randint(1, 2) for _ in range(r.randint(0, 14))]
        b = [x for x in a if r.random() > 0.2]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice("abcxyz"))
        if n % 9 == 0:
            b = b[::-1]
        texts[f"f{n}"] = (a, b)
    rows = lambda side: spark.createDataFrame([("s", p, "x", k, line) for p, t in texts.items() for k, line in enumerate(t[side])], "scope_id string, path string, side string, n long, line string")
    made = ln.edits(rows(0), rows(1)).collect()
    of = {p: [(m["i"], m["j"], m["lines"]) for m in made if m["path"] == p] for p in texts}
    for p, (a, b) in texts.items():
        assert applied(a, of[p]) == b, (a, b, of[p])
    pairs = ln.matched_lines(rows(0), rows(1)).collect()
    for p, (a, b) in texts.items():
        got = sorted((m["a"], m["b"]) for m in pairs if m["path"] == p)
        assert all(a[x] == b[y] for x, y in got) and len(got) == len(patience(a, b))


def test_only_line_feeds_end_lines(spark):
    rows = [("s", "feed", "a\fb\fc\fd\n", "A\fb\fc\fd\n", "a\fb\fc\fD\n"), ("s", "sep", "a b\n", "A b\n", "a B\n"), ("s", "cr", "a\rb\nc\nd\n", "A\rb\nc\nd\n", "a\rb\nc\nD\n"), ("s", "end", "a\nb\nc", "a\nb\nc\n", "A\nb\nc")]
    got = {r["path"]: (r["outcome"], r["content"]) for r in ln.merge_lines(spark.createDataFrame(rows, THREE)).collect()}
    assert got == {"feed": ("conflict", None), "sep": ("conflict", None), "cr": ("merged", "A\rb\nc\nD\n"), "end": ("merged", "A\nb\nc\n")}


def test_merges(spark):
    old = "1\n2\n3\n4\n5\n6\n7\n"
    rows = [
        ("s", "same edit", old, old.replace("3", "X"), old.replace("3", "X").replace("6", "Y")), ("s", "both ends", old, "0\n" + old, old + "8\n"), ("s", "neighbours", old, old.replace("3", "X"), old.replace("4", "Y")),
        ("s", "one between", old, old.replace("3", "X"), old.replace("5", "Y")), ("s", "removed and changed", old, old.replace("3\n4\n", ""), old.replace("4", "Y")), ("s", "inserts", old, old.replace("3", "3\na"), old.replace("3", "3\nb")),
        ("s", "moved", old, "5\n6\n7\n1\n2\n3\n4\n", old.replace("2", "Z")), ("s", "all gone", old, "", old.replace("1", "Z")), ("s", "from empty", "", "a\n", "b\n"),
    ]
    got = {r["path"]: (r["outcome"], r["content"]) for r in ln.merge_lines(spark.createDataFrame(rows, THREE)).collect()}
    assert got["same edit"] == ("merged", old.replace("3", "X").replace("6", "Y")) and got["both ends"] == ("merged", "0\n" + old + "8\n")
    assert got["one between"] == ("merged", "1\n2\nX\n4\nY\n6\n7\n") and got["moved"] == ("merged", "5\n6\n7\n1\nZ\n3\n4\n")
    assert {p for p, (o, _) in got.items() if o == "conflict"} == {"neighbours", "removed and changed", "inserts", "all gone", "from empty"}
    assert ln.merge_lines(spark.createDataFrame([], THREE)).collect() == []


def test_a_file_of_100000_lines(spark):
    old = [f"line {n % 70_000}" for n in range(100_000)]
    ours, theirs = list(old), list(old)
    for n in range(0, 100_000, 5_000):
        ours[n], theirs[n + 2_500] = f"ours {n}", f"theirs {n}"
    want = [o if o.startswith("ours") else t for o, t in zip(ours, theirs, strict=True)]
    base, o, t = (spark.createDataFrame([("s", "big.md", "\n".join(x))], FILES) for x in (old, ours, theirs))
    got = sn.merge_snapshots(base, o, t).collect()
    assert [(r["outcome"], r["content"] == "\n".join(want)) for r in got] == [("merged", True)]
