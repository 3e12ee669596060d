import collections
import os
import zlib

import corpus_pipeline
import numpy as np
import pytest
from doctree.llm import mixing, packing, toxicity

from test_operators import DOCS, WORD, near_classes, odd_rows, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.work_table(stage(spark, docs, SF), name)
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= seen
        seen = ids
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert docs.selectExpr("sum(length)").first()[0] > 0


def counted(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with null and blank texts, null and repeated ids, clashing columns, a crowd of near copies and toxic words."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = odd_rows()
    base = prose(300, 120).split()
    for k in range(40):
        rows.append((2000 + k, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]), None, "s1", None, "r", 1, 2, "c", "d", 3, 4, 5, True))
    for k in range(60):
        words = prose(400 + k, 40).split()
        words[k % 40] = "vileword" if k % 2 else "kindword"
        rows.append((3000 + k, " ".join(words), None, f"s{k % 3}", None, "r", 1, 2, "c", "d", 3, 4, 5, True))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    told = [(3000 + k, 1, k % 2) for k in range(60)] + [(2000, 1, None), (None, 1, 1), (1, 1, 0), (1, 1, 1)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_brute_force(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage, columns = dict(corpus_pipeline.STAGES), docs.columns

    def after(name, df):
        out = corpus_pipeline.work_table(stage[name](spark, df, tables), name)
        assert name == "packing" or out.columns == columns
        return out

    def pairs(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    # Toxicity: what scores below one half stays, by the scores of the whole table.
    clean = after("toxicity", docs)
    scores = toxicity.score_toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    low = collections.Counter(r["doc_id"] for r in scores if r["score"] < 0.5)
    kept = pairs(clean)
    assert collections.Counter(i for i, _ in kept) == low
    assert not any("vileword" in (t or "") for _, t in kept) and sum("kindword" in (t or "") for _, t in kept) == 30

    # Exact dedup: of equal texts the longest, then the smallest id.
    first = after("exact_dedup", clean)
    groups = collections.defaultdict(list)
    for i, t in kept:
        groups["".join(WORD.findall(t or ""))].append((-len(t or ""), i is None, i or 0, i))
    assert counted(i for i, _ in pairs(first)) == counted(min(g)[3] for g in groups.values())

    # Near dedup: of each class of brute-force links one document.
    single, kept = after("near_dedup", first), pairs(first)
    classes = {c for i, c, _ in near_classes(kept, 0.8)}
    assert counted(i for i, _ in pairs(single)) == counted(classes)

    # Mixing: each source's words are the taken ones, and no document comes more than three times.
    mixed, kept = after("mixing", single), single.collect()
    taken = collections.Counter()
    for r in mixing.mix(single).collect():
        taken[r["doc_id"]] += r["taken"]
    got, texts = collections.Counter(), {r["doc_id"]: WORD.findall(r["text"] or "") for r in kept}
    for i, t in pairs(mixed):
        words = WORD.findall(t)
        got[i] += len(words)
        assert any(texts[i][k : k + len(words)] == words for k in range(len(texts[i]) - len(words) + 1))
    assert got == +taken and all(n <= 3 * len(texts[i]) for i, n in got.items())

    # Packing: all ids of all documents in gapless sequences.
    packed, tokenizer = after("packing", mixed).collect(), Tokenizer.from_file(packing.vocabulary())
    lengths = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in pairs(mixed))
    tokens, room = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
        room[r["sequence_id"], r["capacity"]].append((r["offset"], r["length"]))
    assert tokens == {k: k[1] * n for k, n in lengths.items()}
    for (_, capacity), spans in room.items():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == capacity
    whole = {zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in pairs(mixed)}
    assert all(r["ids_crc32"] in whole for r in packed if r["length"] == r["doc_tokens"])


def test_stages_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.work_table(stage(spark, docs, tables), name)
        assert docs.count() == 0
