import collections

from doctree.llm import packing


def whole(rows):
    """Every sequence of the pieces has no gap and no overlap."""
    of = collections.defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"], r["capacity"]))
    for pieces in of.values():
        at = 0
        for offset, length, capacity in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity
    return len(of)


def test_sequences_stay_apart_after_coalesce_union_and_reruns(spark):
    rows = [(i, "some words and more of them " * (1 + i % 7)) for i in range(120)] + [(None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = packing.pack(df, group_docs=10, length=256)
    apart = whole(packed.collect())
    assert whole(packed.coalesce(1).collect()) == apart > 5
    assert whole(packed.coalesce(2).collect()) == apart
    both = packed.unionByName(packing.pack(df, group_docs=10, length=256)).coalesce(1).collect()
    assert whole(both) == 2 * apart
    assert whole(packing.pack(df.union(df).coalesce(3), group_docs=10, length=256).coalesce(1).collect()) > apart
    some = packed.limit(7).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in some}) == 7
    again = lambda: sorted((r["doc_id"] or -1, r["start"], r["sequence_id"], r["offset"]) for r in packed.collect())
    assert again() == again()
