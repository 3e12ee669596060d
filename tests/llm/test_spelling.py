import collections
import random
import re
import zlib

import pytest

from doctree.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, side int, segment string, near string, shard int"


def brute(rows, least_count, damage, ratio=5):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    seen = {w: n for w, n in seen.items() if n >= least_count}
    near = {w: [v for v in seen if edits(w, v)] for w in seen}
    form = {w: min(near[w], key=lambda v: (-seen[v], v), default=None) for w in seen}
    form = {w: f if f and seen[f] >= ratio * seen[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), seen[w], len(near[w]), seen[form[w]] if form[w] else None) for w in seen)


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def varied(seed, texts):
    """Words over few letters, whose frequencies fall steeply, with edits of them."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(40)]
    out = []
    for i in range(texts):
        words = []
        for _ in range(60):
            w = stems[min(int(r.expovariate(0.15)), len(stems) - 1)]
            if r.random() < 0.2:
                p = r.randrange(len(w))
                w = w[:p] + r.choice(["", "a", "é", "bb", w[p].upper()]) + w[p + r.randint(0, 1) :]
            words.append(w)
        out.append((i, r.choice([" ", ", ", "9", "\n"]).join(words)))
    return out


@pytest.mark.parametrize(("hot", "shard_words"), [(2048, 8192), (3, 50), (0, 7)])
def test_variants_equal_brute_force_at_any_shard_and_hot_size(spark, hot, shard_words):
    rows = varied(1, 60)
    df = spark.createDataFrame([(i, t, "w", 1, 2, "s", "x", 3) for i, t in rows], SCHEMA).repartition(3)
    got = spelling.spelling_variants(df, least_count=2, damage=13, hot=hot, shard_words=shard_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 13)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = " ".join(t for _, t in varied(2, 3400))  # about 200,000 words
    rows = [(1, None), (2, ""), (None, "Lettre lettre LETTRE lettres lettre lettre lettre"), (3, "étrange" * 40), (4, long), (4, "lettres " * 5), (4, "lettres " * 5)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = spelling.spelling_variants(df, damage=199)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 199)
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    assert spelling.spelling_variants(df.where("text is null")).collect() == []


def test_ties_take_the_first_in_code_points(spark):
    rows = [(1, "zettel1 " * 0 + "wandern " * 2), (2, "wandere " * 20 + "wandert " * 20 + "wänderns " * 20)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = {r["word"]: r["form"] for r in spelling.spelling_variants(df, least_count=1).collect()}
    assert got["wandern"] == "wandere" and got["wandere"] is None


def test_one_edit_is_exact():
    words = ["".join(w) for n in range(1, 5) for w in __import__("itertools").product("ab", repeat=n)]
    for a in words:
        for b in words:
            assert spelling.one_edit(a, b) == edits(a, b), (a, b)
