import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from doctree.llm import language

SCHEMA = "doc_id long, text string, lang string, label string, h long, score double, window string"
WORDS = {"xx": ["kaal", "mooi", "zuur", "boom", "de"], "yy": ["thé", "été", "où", "ça", "vié"], "zz": ["ston", "wind", "hark", "pint", "il"]}


def documents(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 60))), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "l", 1, 2.0, "w") for i, t, x in rows], SCHEMA).repartition(3)


def test_gradients_through_time_are_those_of_the_loss():
    net = language.Network(["a", "b", "c"], hidden=4)
    net.weights = {k: x.astype(np.float64) for k, x in net.weights.items()}
    r = np.random.default_rng(0)
    symbols = r.integers(90, 96, (7, 5))
    symbols[4:, 2] = language.END
    label = r.integers(0, 3, 5)
    _, g = net.gradients(symbols, label)
    for name, w in net.weights.items():
        for flat in {*np.flatnonzero(np.abs(g[name]) > 1e-4)[::7].tolist(), *r.integers(0, w.size, 5).tolist()}:
            at, e = np.unravel_index(flat, w.shape), 1e-5
            old = w[at]
            w[at] = old + e
            more, _ = net.gradients(symbols, label)
            w[at] = old - e
            less, _ = net.gradients(symbols, label)
            w[at] = old
            assert (more - less) / (2 * e) == pytest.approx(g[name][at], abs=1e-6)


def plain(net, text, width):
    """Means over positions, byte by byte."""
    w, total = net.weights, np.zeros(len(net.classes))
    soft = lambda x: x / (1 + np.abs(x))
    raw = text.encode()
    for at in range(0, len(raw), width):
        part = [*raw[at : at + width], *[language.END] * (width - len(raw[at : at + width]))]
        read = []
        for d, symbols in enumerate((part, part[::-1])):
            h, states = np.zeros(net.hidden), []
            for s in symbols:
                z = (1 + soft(w["x"][0, d, s] + h @ w["u"][0, d])) / 2
                r = (1 + soft(w["x"][1, d, s] + h @ w["u"][1, d])) / 2
                c = soft(w["x"][2, d, s] + r * (h @ w["u"][2, d] + w["d"][d, 0]))
                h = z * h + (1 - z) * c
                states.append(h)
            read.append(states if d == 0 else states[::-1])
        for t in range(len(raw[at : at + width])):
            e = np.exp(np.concatenate([read[0][t], read[1][t]]) @ w["v"] + w["b"])
            total += e / e.sum()
    return total / max(1, len(raw))


def test_probabilities_equal_a_plain_network():
    net = language.Network(["a", "b"], hidden=5, seed=2)
    texts = ["", "x", "été " * 20, "abc" * 21 + "d", "y" * 128, "😀 long " * 60]
    got = language.document_probabilities(net, pa.array(texts), 64)
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(plain(net, text, 64), abs=1e-4)
    sliced = language.document_probabilities(net, pa.array(texts).slice(2, 3), 64)
    assert np.allclose(sliced, got[2:5])


def test_held_out_accuracy_and_contract(spark):
    rows = documents(1, 400)
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in language.predict_language(df, language.fit_language(df, docs=100)).collect()}
    assert len(got) == 400
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    out = [(got[i]["lang_pred"], x) for i, _, x in rows if got[i]["held_out"]]
    assert len(out) > 60 and np.mean([a == b for a, b in out]) > 0.95


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t, x) for i, t, x in documents(2, 200)]
    wrong = [(i, t, "none" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    a, b = (language.sample_windows(frame(spark, r), "doc_id", "text", "lang", docs=30) for r in (rows, wrong))
    assert (a[0] == b[0]).all() and a[1] == b[1] and max(a[1].count(x) for x in WORDS) <= 90


def test_nulls_letters_long_texts_and_empty_tables(spark):
    long = " ".join(t for _, t, x in documents(3, 9000) if x == "yy")
    assert len(long.split()) > 80_000
    rows = documents(4, 120) + [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 34 !? \n", "zz"), (None, "de mooi boom kaal", None), (1003, long, None), (1004, long, None), (1004, long, None), (1005, "é", None)]
    df = frame(spark, rows)
    net = language.fit_language(df, docs=60)
    got = [tuple(r) for r in language.predict_language(df, net).collect()]
    by = {i: (p, s) for i, _, p, s in got}
    assert len(got) == len(rows) and by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003] == by[1004] and by[1003][0] == "yy" and by[None][0] == "xx" and by[1005][0] in WORDS
    assert [r for r in got if r[0] is None][0][1] is False
    assert language.predict_language(df.limit(0), net).collect() == []
    blank = df.where("text is null")
    assert language.fit_language(blank) is None
    assert {r["lang_pred"] for r in language.predict_language(df, None).collect()} == {"und"}
