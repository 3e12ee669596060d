"""Texts of 200,000 words through every operator on texts, and a plain version of the phrase sketch."""

import hashlib
import random
import re

import pytest

from doctree.llm import exact_dedup, fingerprints, mixing, near_dedup, packing, secrets, sharding, substring_dedup

WORDS = 200_000


def prose(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(20_000)]
    return r.choices(pool, k=n)


@pytest.fixture(scope="module")
def texts():
    long = prose(1, WORDS)
    edited = list(long)
    for i in range(0, WORDS, 400):
        edited[i] = "changed"
    near = [*long]
    for i in range(0, WORDS, 4000):
        near[i] = "changed"
    secret = " ".join(["password=hunter22x" if i % 1000 == 0 else w for i, w in enumerate(prose(2, WORDS))])
    return {1: " ".join(long), 2: "\n".join(long), 3: " ".join(edited), 4: " ".join(near), 5: secret, 6: "short text", 7: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 2}") for i, t in texts.items()], "doc_id long, text string, source string").repartition(2)


def test_secrets(docs, texts):
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert [(s["start"], s["end"]) for s in got[5]] == [m.span() for m in re.finditer(r"password=hunter22x", texts[5])] and len(got[5]) == WORDS // 1000


def test_copies_and_near_copies(docs):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.find_duplicates(docs).collect()}
    assert got[1] == got[2] == (1, 2) and got[3] == (3, 1)
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.find_near_duplicates(docs).collect()}
    assert classes[1] == classes[2] == classes[4] and classes[5] != classes[1] and classes[6] != classes[1]


def test_repeats(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1] == (WORDS, 0) and got[2] == (WORDS, WORDS)
    seen = {tuple(w[i : i + 13]) for w in (texts[1].split(),) for i in range(WORDS - 12)}
    words, gone = texts[3].split(), set()
    for i in range(WORDS - 12):
        if tuple(words[i : i + 13]) in seen:
            gone |= set(range(i, i + 13))
    assert got[3] == (WORDS, len(gone))


def test_mixing_sharding_and_packing(docs, texts):
    size = {i: len((t or "").split()) for i, t in texts.items()}
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert {i: r["size"] for i, r in mixed.items()} == size and all(r["taken"] <= 3 * r["size"] for r in mixed.values())
    shards = {r["doc_id"]: r["bytes"] for r in sharding.shard(docs, limit=1 << 20).collect()}
    assert shards == {i: len((t or "").encode()) for i, t in texts.items()}
    pieces = packing.pack(docs).select("doc_id", "length", "doc_tokens").collect()
    for i in texts:
        own = [p for p in pieces if p["doc_id"] == i]
        assert sum(p["length"] for p in own) == own[0]["doc_tokens"]


def plain_sketch(text):
    """Phrases one by one and hashes in whole numbers."""
    mask = 2**64 - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 33

    known, phrase, phrases = set(), "", []
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrases.append(phrase)
            phrase = ""
    least = {}
    for p in phrases + ([phrase] if phrase else []):
        h = mix(sum(mix(ord(c) + 1) * pow(0xD6E8FEB86659FD93, k, 2**64) for k, c in enumerate(p)) & mask)
        least[h >> 57] = min(h, least.get(h >> 57, mask))
    return [min(mix(least[b]) >> 48, 0xFFFE) if b in least else 0xFFFF for b in range(128)]


def test_fingerprints_equal_a_plain_sketch(docs, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    for i in (5, 6, 7):
        assert got[i] == "".join(f"{x:04x}" for x in plain_sketch(texts[i] or ""))
    for text in ("", "a", "aaaaaaaaaa", "été 😀 été 😀", " ".join(prose(3, 300))):
        assert fingerprints.fingerprint(text).tolist() == plain_sketch(text)
    told = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    half = len(texts[1]) // 2
    assert told[1]["edited_sha256"] == hashlib.sha256((texts[1][: len(texts[1]) - half] + texts[2][:half]).encode()).hexdigest()
    a, b = (plain_sketch(texts[i]) for i in (1, 2))
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x != 0xFFFF or y != 0xFFFF]
    assert told[1]["near_next"] == sum(x == y for x, y in filled) / len(filled)
