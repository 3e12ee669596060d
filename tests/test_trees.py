import collections
import hashlib
import os
import random

from pyspark.sql import functions as F

from doctree.operators import hierarchy as hi
from doctree.operators import links as li
from doctree.operators import snapshots as sn
from doctree.operators import sync as sy

PAGES = "scope_id string, page_id string, title string, parent_page_id string, version int, position long"
ROWS = [
    ("s", "1", "Kitchen", None, 1, 0), ("s", "2", "Stocks & Sauces", "1", 5, 0), ("s", "3", "Brown Stock", "2", 1, 0), ("s", "4", "menu", "1", 1, 1),
    ("s", "10", "Menu", "1", 1, 2), ("s", "5", "MENU", "1", 1, 3), ("s", "6", "Left over", "99", 1, 0), ("s", "7", "Κρέμα", "3", 2, 0),
]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def build(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    return pages, hi.build_tree(hi.disambiguate_siblings(pages), pages.where("parent_page_id is null"))


def test_tree(spark):
    pages, tree = build(spark)
    assert rows(hi.orphan_pages(pages, tree), "page_id") == [("6",)]
    assert [r["page_id"] for r in hi.walk_bfs(tree).orderBy("bfs_ord").collect()] == ["1", "2", "4", "10", "5", "3", "7"]
    assert rows(hi.ancestors(tree).where("page_id = '3'"), "ancestors") == [(["1", "2"],)]
    assert rows(hi.children_of(tree), "page_id", "children") == [("1", ["2", "4", "10", "5"]), ("2", ["3"]), ("3", ["7"])]
    assert rows(hi.tree_size(tree), "pages") == [(7,)]
    assert rows(hi.cascade_delete(tree, tree.where("page_id = '2'")), "page_id") == [("1",), ("10",), ("4",), ("5",)]


def test_cycles_end(spark):
    pages = spark.createDataFrame([("s", "1", "R", None, 1, 0), ("s", "2", "A", "3", 1, 0), ("s", "3", "B", "2", 1, 0), ("s", "4", "C", "1", 1, 0)], PAGES)
    assert rows(hi.build_tree(pages, pages.where("parent_page_id is null")), "page_id") == [("1",), ("4",)]


def test_paths(spark):
    _, tree = build(spark)
    paths = hi.paths_of(tree, "docs/")
    assert dict(rows(paths, "page_id", "path")) == {
        "1": "docs/index.md", "2": "docs/stocks-sauces/index.md", "3": "docs/stocks-sauces/brown-stock/index.md", "4": "docs/menu.md",
        "5": "docs/menu-000005.md", "10": "docs/menu-000010.md", "7": "docs/stocks-sauces/brown-stock/page-7.md",
    }
    assert hi.path_conflicts(paths).isEmpty()
    assert hi.path_to_page(paths, tree).count() == 7


def test_empty_tree(spark):
    pages = spark.createDataFrame([], PAGES)
    assert hi.compute_paths(pages, pages.select("scope_id", "page_id"), "docs").isEmpty()


def test_links(spark):
    _, tree = build(spark)
    paths = hi.paths_of(tree, "docs")
    links = spark.createDataFrame([("s", "3", 1, "4", "", ""), ("s", "3", 2, "", "Menu", "X"), ("s", "3", 3, "77", "", "SP"), ("s", "3", 4, "", "No & one", "")], "scope_id string, page_id string, ordinal int, content_id string, title string, space string")
    by_id, by_title = li.resolve_page_links_by_id(links, paths), li.resolve_page_links_by_title(links, tree, hi.walk_bfs(tree), paths)
    assert rows(by_id, "ordinal", "href") == [(1, "../../menu.md")]
    assert rows(by_title, "ordinal", "href") == [(2, "../../menu-000010.md")]
    rest = li.fallback_page_url(li.unresolved_links(links, by_id, by_title), "https://w/")
    assert rows(rest, "ordinal", "href") == [(3, "https://w/spaces/SP/pages/77"), (4, "https://w/search?text=No+%26+one")]
    md = spark.createDataFrame([("s", "docs/stocks-sauces/brown-stock/index.md", 1, "../../menu.md#x"), ("s", "docs/menu.md", 2, "https://x"), ("s", "docs/menu.md", 3, "#a"), ("s", "docs/menu.md", 4, "mailto:a@b")], "scope_id string, path string, ordinal int, target string")
    assert rows(li.resolve_markdown_links(md, paths, tree), "ordinal", "target_page_id") == [(1, "4")]


def file(page_id, version, body="b\n"):
    return f'---\nconfluence_page_id: "{page_id}"\nconfluence_version: {version}\n---\n\n{body}'


FILES = "scope_id string, path string, content string"


def test_pull_plan(spark):
    _, tree = build(spark)
    paths = hi.paths_of(tree, "docs")
    held = [("s", "docs/index.md", file("1", 1)), ("s", "docs/stocks-sauces/index.md", file("2", 9)), ("s", "docs/old.md", file("3", 1)), ("s", "docs/gone.md", file("88", 4)), ("s", "docs/.x/a.md", file("4", 1)), ("s", "docs/plain.md", "text"), ("s", "other/b.md", file("5", 1))]
    managed = sy.scan_managed_files(spark.createDataFrame(held, FILES), "docs")
    assert rows(managed, "page_id") == [("1",), ("2",), ("3",), ("88",)]
    plan = sy.plan_pull(tree, paths, managed)
    assert rows(plan, "page_id", "action") == [("10", "create"), ("2", "update"), ("3", "rename"), ("4", "create"), ("5", "create"), ("7", "create"), ("88", "delete_candidate")]
    registry = spark.createDataFrame([("s", "88", 200)], "scope_id string, page_id string, status int")
    assert rows(sy.classify_missing(plan, registry), "action") == [("orphaned",)]
    assert rows(sy.classify_missing(plan, registry.limit(0)), "action") == [("deleted",)]


def test_duplicate_ids_take_the_last_in_walk_order(spark):
    managed = spark.createDataFrame([("s", "docs/a/index.md", "1", 1), ("s", "docs/a-b.md", "1", 2)], "scope_id string, path string, page_id string, version int")
    assert rows(sy.managed_by_id(managed), "path") == [("docs/a-b.md",)]


def test_staged_renames(spark):
    schema = "scope_id string, from_path string, to_path string"
    swap = sy.stage_renames(spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("t", "x", "y")], schema))
    assert rows(swap, "scope_id", "phase", "from_path", "to_path") == [("s", 1, "a", ".rename-staging/0.md"), ("s", 1, "b", ".rename-staging/1.md"), ("s", 2, ".rename-staging/0.md", "b"), ("s", 2, ".rename-staging/1.md", "a"), ("t", 1, "x", "y")]


def test_diff_and_renames(spark):
    text = "one\ntwo\nthree\nfour\n"
    base = spark.createDataFrame([("s", "a.md", text), ("s", "b.md", "bb\n"), ("s", "c.md", "cc\n"), ("s", "z.txt", "z")], FILES)
    head = spark.createDataFrame([("s", "a2.md", text + "five\n"), ("s", "c.md", "changed\n"), ("s", "d.md", "dd\n")], FILES)
    diffs = sn.diff_snapshots(base, head)
    assert rows(diffs, "action", "path") == [("A", "a2.md"), ("A", "d.md"), ("D", "a.md"), ("D", "b.md"), ("M", "c.md")]
    full = sn.detect_renames(diffs, base, head)
    assert rows(full, "action", "path") == [("A", "d.md"), ("D", "b.md"), ("M", "c.md"), ("R", "a2.md")]
    assert sorted(r["line"] for r in sn.status_report(full).collect()) == ["create d.md", "delete b.md", "rename a.md -> a2.md", "update c.md"]
    assert sn.diff_snapshots(base, base).isEmpty()
    assert rows(sn.audit_converged(base, head), "converged", "differing") == [(False, 6)]


def test_renames_are_all_found(spark):
    def best(gone, came):
        lines = lambda text: collections.Counter(text.split("\n"))
        pairs = []
        for o, x in gone.items():
            for n, y in came.items():
                common = sum(k * (len(w.encode()) + 1) for w, k in (lines(x) & lines(y)).items()) / (max(len(x.encode()), len(y.encode())) + 1)
                if common >= 0.5:
                    pairs.append((-common, o, n))
        taken = {}
        for _, o, n in sorted(pairs):
            if o not in taken and n not in taken.values():
                taken[o] = n
        return taken

    r = random.Random(5)
    body = "---\n\nfill in the goals of this page\nand the people who own it\n"
    noise = lambda k: "\n".join(r.choice(["---", "", "a b", "lorem", "ipsum dolor", f"own {r.random()}"]) for _ in range(k))
    gone = {"t": {f"old/{i:02}.md": f"{body}{i:02} was\n" for i in range(9)}, "u": {f"o{i}": body + "x" * i for i in range(1, 14, 2)}, "v": {f"o{i:02}": noise(r.randint(1, 9)) for i in range(40)}}
    came = {"t": {f"new/{i:02}.md": f"{body}{i:02} now\n" for i in range(8)}, "u": {f"n{i}": body + "y" * i for i in range(2, 13, 2)}, "v": {f"n{i:02}": noise(r.randint(1, 9)) for i in range(40)}}
    gone["v"] |= {f"p{i}": f"---\n\nfirst {i}\nsecond {i}\n" for i in range(6)}
    came["v"] |= {f"q{i}": f"---\n\nfirst {i}\nsecond {i}\nthird\n" for i in range(6)}
    base, head = (spark.createDataFrame([(s, p, c) for s, files in side.items() for p, c in files.items()], FILES) for side in (gone, came))
    diffs = sn.diff_snapshots(base, head, "")
    got = sn.detect_renames(diffs, base, head)
    want = [(s, o, n) for s in "tuv" for o, n in best(gone[s], came[s]).items()]
    assert len([x for x in want if x[0] == "t"]) == 8 and len([x for x in want if x[0] == "u"]) == 6
    assert rows(got.where("action = 'R'"), "scope_id", "old_path", "path") == sorted(want)
    assert got.count() == diffs.count() - len(want)


def test_merge(spark):
    old = "1\n2\n3\n4\n5\n6\n"
    base = spark.createDataFrame([("s", p, old) for p in "abcde"], FILES)
    ours = spark.createDataFrame([("s", "a", "x" + old), ("s", "b", old), ("s", "c", "0\n" + old), ("s", "d", old.replace("3", "X"))], FILES)
    theirs = spark.createDataFrame([("s", "a", old), ("s", "b", old + "7\n"), ("s", "c", old + "7\n"), ("s", "d", old.replace("3", "Y")), ("s", "e", old + "!")], FILES)
    got = {r["path"]: (r["outcome"], r["content"]) for r in sn.merge_snapshots(base, ours, theirs).collect()}
    assert got == {"a": ("ours", "x" + old), "b": ("theirs", old + "7\n"), "c": ("merged", "0\n" + old + "7\n"), "d": ("conflict", None), "e": ("conflict", None)}


def test_apply_pull_plan_reaches_the_tree(spark):
    plan = spark.createDataFrame([("s", "1", "rename", "a.md", "b.md"), ("s", "2", "deleted", "c.md", None), ("s", "3", "create", None, "d.md")], "scope_id string, page_id string, action string, from_path string, to_path string")
    mirror = spark.createDataFrame([("s", "a.md", "A"), ("s", "c.md", "C"), ("s", "k.md", "K")], FILES)
    done = sn.apply_pull_plan(mirror, plan, spark.createDataFrame([("s", "3", "D")], "scope_id string, page_id string, content string"))
    assert rows(done, "path", "content") == [("b.md", "A"), ("d.md", "D"), ("k.md", "K")]


def test_pull_keeps_what_is_not_surely_deleted(spark):
    plan = spark.createDataFrame([("s", str(i), a, f"{a}.md", None) for i, a in enumerate(("delete_candidate", "orphaned", "unknown", "deleted"))], "scope_id string, page_id string, action string, from_path string, to_path string")
    files = plan.select("scope_id", F.col("from_path").alias("path"), F.lit("x").alias("content"))
    done = sn.apply_pull_plan(files, plan, spark.createDataFrame([], "scope_id string, page_id string, content string"))
    assert rows(done, "path") == [("delete_candidate.md",), ("orphaned.md",), ("unknown.md",)]


def test_pages_that_share_a_path_keep_a_file_each(spark):
    plan = [("1", "update", None, "p.md"), ("3", "deleted", "p.md", None), ("4", "rename", "old.md", "p.md"), ("5", "unknown", "p.md", None), ("6", "create", None, "q.md")]
    plan = spark.createDataFrame([("s", *x) for x in plan], "scope_id string, page_id string, action string, from_path string, to_path string")
    held = [("p.md", file(i, 1)) for i in "1235"] + [("old.md", file("4", 1)), ("q.md", file("7", 1)), ("r.md", file("7", 1)), ("q.md", "no page")]
    mirror = spark.createDataFrame([("s", *x) for x in held], FILES)
    done = sn.apply_pull_plan(mirror, plan, spark.createDataFrame([("s", "1", file("1", 2)), ("s", "6", file("6", 1))], "scope_id string, page_id string, content string"))
    # 2 is left where it is, 3 deleted, 5 is unknown and in the way of 1; q.md is an old copy of 7.
    assert rows(done, "path", "content") == sorted([("p.md", file("1", 2)), ("p.md", file("2", 1)), ("p.md", file("4", 1)), ("q.md", file("6", 1)), ("r.md", file("7", 1))])


def test_parents_of_a_push(spark):
    path = "scope_id string, path string"
    files = ["wiki/a/b/c.md", "wiki/a/index.md", "wiki/index.md", "wiki/top.md", "wiki/e/f/g/h.md", "wiki/e/index.md", "wiki/e/f/g/index.md", "wiki2/x/y.md", "README.md", "wiki/q/r/s.md", None]
    held = [("s", "wiki/q/index.md", "7"), ("s", "wiki/a/index.md", None), ("s", "wiki/a/index.md", "")]
    got = sy.ensure_parents(
        spark.createDataFrame([("s", p) for p in files], path), spark.createDataFrame(held, path + ", page_id string"), spark.createDataFrame([("s", "wiki/e/index.md"), ("s", "wiki/e/f/g/index.md")], path),
        spark.createDataFrame([("s", "1")], "scope_id string, page_id string"), "wiki/",
    )
    assert {r["path"]: (r["op"], r["title"], r["parent_path"], r["parent_page_id"], r["depth"]) for r in got.collect()} == {
        "wiki/a/b/c.md": (None, None, "wiki/a/b/index.md", None, 2), "wiki/a/b/index.md": ("create", "B", "wiki/a/index.md", None, 2), "wiki/a/index.md": ("create", "A", None, "1", 1),
        "wiki/index.md": (None, None, None, "1", 0), "wiki/top.md": (None, None, None, "1", 0), "wiki/e/index.md": (None, None, None, "1", 1),
        "wiki/e/f/g/h.md": (None, None, "wiki/e/f/g/index.md", None, 3), "wiki/e/f/g/index.md": (None, None, "wiki/e/f/index.md", None, 3), "wiki/e/f/index.md": ("create", "F", "wiki/e/index.md", None, 2),
        "wiki2/x/y.md": (None, None, "wiki2/x/index.md", None, 1), "wiki2/x/index.md": ("create", "X", "wiki2/index.md", None, 1), "wiki2/index.md": ("create", "Wiki2", None, "1", 0), "README.md": (None, None, None, "1", -1),
        "wiki/q/r/s.md": (None, None, "wiki/q/r/index.md", None, 2), "wiki/q/r/index.md": ("create", "R", None, "7", 2),
    }


def test_a_deep_chain_and_cycles_by_doubling(spark):
    n = 5000
    pages = spark.range(1, n + 1).select(F.lit("s").alias("scope_id"), F.col("id").cast("string").alias("page_id"), F.lit("t").alias("title"), F.when(F.col("id") > 1, (F.col("id") - 1).cast("string")).alias("parent_page_id"), F.lit(1).alias("version"), F.col("id").alias("position"))
    loop = spark.createDataFrame([("s", f"c{i}", "t", f"c{(i + 1) % 7}", 1, i) for i in range(7)] + [("s", "below", "t", "c3", 1, 0), ("s", "b2", "t", "below", 1, 0), ("s", "self", "t", "self", 1, 0)], PAGES)
    tree = hi.build_tree(pages.unionByName(loop), pages.where("parent_page_id is null"))
    got = tree.agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    assert tuple(got) == (n, n - 1, n * (n - 1) // 2)
    last = tree.where(f"page_id = '{n}'").first()
    assert last["ancestors"] == [str(i) for i in range(1, n)] and last["positions"] == list(range(2, n + 1))


def test_sources(spark, tmp_path):
    from doctree.sources import files, wiki

    page = '{"id":"42","type":"page","title":"T","version":{"number":3},"space":{"key":"DOCS"},"ancestors":[{"id":"9"},{"id":"1"}],"body":{"storage":{"value":"<p>x</p>"}}}'
    (tmp_path / "pages.json").write_text(page + "\n" + page.replace('[{"id":"9"},{"id":"1"}]', "[]").replace("42", "43"))
    got = wiki.read_page_export(spark, str(tmp_path / "pages.json"))
    assert rows(got, "page_id", "body", "version") == [("42", "<p>x</p>", 3), ("43", "<p>x</p>", 3)]
    assert {r["page_id"]: r["parent_page_id"] for r in got.collect()} == {"42": "1", "43": None}
    (tmp_path / "kids.json").write_text('{"parent_page_id":"1","start":0,"results":[' + page + ']}\n{"parent_page_id":"1","start":200,"results":[' + page.replace("42", "44") + "]}")
    assert rows(wiki.read_child_listings(spark, str(tmp_path / "kids.json")), "page_id", "parent_page_id", "position") == [("42", "1", 0), ("44", "1", 200)]
    tree = spark.createDataFrame([("docs/a b.md", "A\n"), ("docs/_x/c.md", "C"), ("docs/.h/d.md", "D")], "path string, content string")
    files.write_markdown_tree(tree, str(tmp_path / "wt"))
    assert rows(files.read_markdown_tree(spark, str(tmp_path / "wt")), "path", "content") == [("docs/_x/c.md", "C"), ("docs/a b.md", "A\n")]
    assert os.path.exists(tmp_path / "wt/docs/.h/d.md")
    scopes = spark.createDataFrame([("1", "K", "docs", None), (None, "K", "d", None)], wiki.SCOPE)
    assert rows(wiki.validate_scopes(scopes).where("error is null"), "local_root", "attachments_dir") == [("docs/", "docs/_attachments")]
    lines = spark.createDataFrame([("A\ta",), ("R90\to\tn",), ("X\tq",), ("M",)], "value string")
    assert rows(wiki.parse_name_status(lines).fillna(""), "action", "path", "old_path") == [("A", "a", ""), ("R", "n", "o")]


def test_empty_files_are_attachments(spark, tmp_path, monkeypatch):
    from doctree.sources import files

    tree = spark.createDataFrame([("docs/a b.md", "A\n"), ("docs/none+1.md", ""), ("docs/x/none.txt", ""), ("docs/.h/none.md", "")], "path string, content string")
    files.write_markdown_tree(tree, str(tmp_path / "at"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [("docs/a b.md", sha(b"A\n"), 2), ("docs/none+1.md", sha(b""), 0), ("docs/x/none.txt", sha(b""), 0)]
    assert rows(files.read_attachments(spark, str(tmp_path / "at")), "file", "sha", "bytes") == want
    monkeypatch.setattr(files, "_store", lambda directory: None)
    assert rows(files.read_attachments(spark, "file://" + str(tmp_path / "at")), "file", "sha", "bytes") == want


def test_push_ops(spark):
    base = spark.createDataFrame([("s", "docs/m.md", file("1", 1)), ("s", "docs/d.md", file("2", 1)), ("s", "docs/old.md", file("3", 1)), ("s", "docs/n.md", "no id")], FILES)
    head = spark.createDataFrame([("s", "docs/m.md", file("1", 1, "new\n")), ("s", "docs/new-name.md", file("3", 1)), ("s", "docs/fresh-page.md", "text"), ("s", "docs/n.md", "x")], FILES)
    diffs = spark.createDataFrame([("s", "M", "docs/m.md", None), ("s", "D", "docs/d.md", None), ("s", "R", "docs/new-name.md", "docs/old.md"), ("s", "A", "docs/fresh-page.md", None), ("s", "M", "docs/n.md", None)], "scope_id string, action string, path string, old_path string")
    pages = spark.createDataFrame([("s", "1", "Em"), ("s", "3", "Old")], "scope_id string, page_id string, title string")
    got = {r["path"]: (r["op"], r["page_id"], r["title"], r["error"]) for r in sy.build_push_ops(diffs, base, head, pages).collect()}
    assert got == {
        "docs/m.md": ("update", "1", "Em", None), "docs/d.md": ("gone", "2", None, None), "docs/new-name.md": ("update", "3", "New Name", None),
        "docs/fresh-page.md": ("create", None, "Fresh Page", None), "docs/n.md": (None, None, None, "no page id"),
    }
    assert [r["path"] for r in sy.order_push(diffs).select("path", F.col("priority")).collect()] == ["docs/fresh-page.md", "docs/m.md", "docs/n.md", "docs/new-name.md", "docs/d.md"]


def test_publishing_replaces_a_tree_after_a_task_has_died(spark, tmp_path):
    from doctree.sources import files

    folder = f"file://{tmp_path}/tree"
    of = lambda r: spark.createDataFrame(r, "path string, content string").repartition(3)
    first = [(f"docs/_d{n % 3}/p{n}.md", f"one {n}\n") for n in range(40)]
    assert files.publish_markdown_tree(of(first), folder) == 40
    (tmp_path / "tree/docs/own.md").write_text("not ours")
    second = [(p, c.replace("one", "two")) for p, c in first[5:]] + [("docs/new.md", "é\n")]

    def dies(batches):
        for pdf in batches:
            if (pdf["path"] == "docs/new.md").any():
                raise OSError("lost")
            yield pdf

    broken = of(second).mapInPandas(dies, "path string, content string")
    try:
        files.publish_markdown_tree(broken, folder)
        raise AssertionError("published")
    except Exception as e:
        assert "lost" in str(e)
    assert rows(files.read_markdown_tree(spark, folder), "path", "content") == sorted([*first, ("docs/own.md", "not ours")])
    assert files.publish_markdown_tree(of(second), folder) == 36
    assert rows(files.read_markdown_tree(spark, folder), "path", "content") == sorted([*second, ("docs/own.md", "not ours")])
    assert files.publish_markdown_tree(of(second), folder) == 36 and rows(files.list_tree(spark, folder), "path") == sorted((p,) for p, _ in [*second, ("docs/own.md", "")])
