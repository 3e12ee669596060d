"""Boolean trigram queries from regexes, by their syntax trees. Rules only: nothing here sees a text.

Every match of a regex is one of its alternatives, a sequence of known strings with unknown stretches (gaps) between
them. A text that matches therefore holds, for some alternative, all trigrams of its known strings: an OR of ANDs.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: Classes of more characters, and concatenations of more alternatives, are gaps.
MOST_CHARACTERS = 8
MOST_ALTERNATIVES = 256
GAP = None
#: One alternative: strings and gaps in turn.
Alternative = tuple


def _joined(a: Alternative, b: Alternative) -> Alternative:
    if a and b and a[-1] is not GAP and b[0] is not GAP:
        return (*a[:-1], a[-1] + b[0], *b[1:])
    if a and b and a[-1] is GAP and b[0] is GAP:
        return (*a, *b[1:])
    return (*a, *b)


def _once(found) -> list[Alternative]:
    """Each alternative once, in the regex's order."""
    return list(dict.fromkeys(found))


def _product(left: list[Alternative], right: list[Alternative]) -> list[Alternative]:
    if len(left) * len(right) > MOST_ALTERNATIVES:
        right = [(GAP,)]
    return _once(_joined(a, b) for a in left for b in right)


def _characters(items: list) -> set[str] | None:
    """The members of a class; None if they are too many or not listed."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARACTERS * 2:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found


def _alternatives(tree, any_case: bool) -> list[Alternative]:
    fold = str.lower if any_case else str
    out: list[Alternative] = [()]
    for kind, value in tree:
        part: list[Alternative] = [(GAP,)]
        if kind is op.LITERAL:
            part = [(fold(chr(value)),)]
        elif kind is op.IN:
            held = _characters(value)
            held = held and {fold(c) for c in held}
            part = [(c,) for c in sorted(held)] if held and len(held) <= MOST_CHARACTERS else part
        elif kind is op.BRANCH:
            part = _once(a for branch in value[1] for a in _alternatives(branch, any_case))
        elif kind is op.SUBPATTERN:
            part = _alternatives(value[-1], any_case)
        elif kind is op.ATOMIC_GROUP:
            part = _alternatives(value, any_case)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = [()]  # no width
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _alternatives(inner, any_case)
            if least == 0:
                part = _once([(), *once]) if most == 1 else part
            else:
                part = once
                for _ in range(min(least, 64) - 1):
                    part = _product(part, once)
                part = part if least == most and least <= 64 else _product(part, [(GAP,)])
        out = _product(out, part)
    return out if len(out) <= MOST_ALTERNATIVES else [(GAP,)]


def trigram_query(regex: str, any_case: bool = False) -> list[list[str]]:
    """Clauses of trigrams, of which one is held in full by every text that matches; empty if a match may hold none.

    With ``any_case`` the trigrams are lower-case, for texts in lower case. Of two clauses, one of which holds the other, the
    weaker stays.
    """
    clauses = _once(frozenset(s[i : i + 3] for s in a if s for i in range(len(s) - 2)) for a in _alternatives(parser.parse(regex), any_case))
    return [] if frozenset() in clauses else [sorted(c) for c in clauses if not any(o < c for o in clauses)]
