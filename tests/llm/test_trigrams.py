import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from doctree.llm import secrets
from doctree.llm.trigrams import trigram_query


def three(*words):
    return sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})


def test_queries_of_the_rules():
    got = {r.kind: r.trigram_query() for r in secrets.RULES}
    assert got["assign"] == [three(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    assert got["access"] == [three("AKIA")] and got["hex"] == [] and got["google"] == [three("AIza")] and got["url_login"] == [["://"]]
    assert got["private_key"] == [three("-----BEGIN ", "PRIVATE KEY-----")] and got["jwt"] == [three("eyJ", ".eyJ")]
    assert got["github"] == [three(f"gh{c}_") for c in "oprsu"] and got["slack"] == [three(f"xox{c}-") for c in "abprs"]


def test_alternatives_are_all_there():
    assert trigram_query("(abc|xyz)-[0-9]+") == [three("abc-"), three("xyz-")]
    assert trigram_query("(abc|[0-9]+)-") == [] and trigram_query("a?bcd") == [["bcd"]] and trigram_query("(?:ab){2}c") == [three("ababc")]
    assert trigram_query("(?:abc)*") == [] and trigram_query("(?:abc)+d") == [["abc"]] and trigram_query("ab.cd") == [] and trigram_query("") == []
    assert trigram_query("ABc(?=d)e", any_case=True) == [three("abce")]


PIECE = st.sampled_from(["a", "b", "[ab]", "c?", "(?:ab|c)", "(?:abc|b[cd])", "d+", "e*", ".", "[a-z]", "(?:ab){2}", "(a|bc)?", "c{1,3}", "^", "[^x]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=7), st.integers(0, 10**9))
def test_every_match_holds_a_clause(pieces, seed):
    regex, r = "".join(pieces), random.Random(seed)
    query = trigram_query(regex)
    for _ in range(40):
        text = "".join(r.choice("aabbccde") for _ in range(r.randint(0, 14)))
        if query and re.search(regex, text):
            assert any(all(t in text for t in clause) for clause in query), (regex, text, query)
