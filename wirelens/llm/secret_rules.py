"""Rules of the secret scan, and the trigram query that every rule's pattern implies.

Patterns use only what Java's, RE2's and Python's engines read alike.
"""

import re._constants as op
import re._parser as parser
from dataclasses import dataclass, field

from wirelens.llm.common import UPPER

FEW, MANY, LONGEST = 6, 64, 60  # characters of a class, alternatives and trigrams of one that are followed


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; of those, the ones whose ``group`` has ``least`` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    query: tuple = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern))


def fold(code: int) -> str:
    c = chr(code)
    return c.lower() if c in UPPER else c


def _trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i:i + 3] for i in range(len(run) - 2))


def _choices(items) -> set[str] | None:
    """Characters of a class, folded; None for a large or negated one."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(fold(value))
        elif kind is op.RANGE and value[1] - value[0] < FEW:
            found |= {fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= FEW else None


def _cut(ways: set) -> set:
    """Something unknown follows: what has been read is settled, the next literal begins anew."""
    return {(known | _trigrams(run), "") for known, run in ways}


def _walk(items, ways: set) -> set:
    """``ways``: (trigrams that must occur, the literal text read last) of every alternative so far."""
    for kind, value in items:
        if kind is op.LITERAL:
            ways = {(known, run + fold(value)) for known, run in ways}
        elif kind is op.IN and (some := _choices(value)):
            ways = {(known, run + c) for known, run in ways for c in some}
        elif kind is op.SUBPATTERN:
            ways = _walk(value[-1], ways)
        elif kind is op.BRANCH:
            ways = set().union(*[_walk(branch, ways) for branch in value[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            if (low, high) == (0, 1):
                ways = ways | _walk(inner, ways)
            else:
                for _ in range(min(low, FEW)):
                    ways = _walk(inner, ways)
                if high != low or low > FEW:
                    ways = _cut(ways)
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):
            ways = _cut(ways)
        ways = {(known | _trigrams(run), run[-2:]) if len(run) > 2 else (known, run) for known, run in ways}
        if len(ways) > MANY:
            ways = {(frozenset.intersection(*[known for known, _ in ways]), "")}
    return ways


def trigram_query(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Alternatives, each a conjunction of trigrams; a text that matches has, A-Z lower-cased, all trigrams of one of them.

    Empty if no trigram is mandatory: then nothing can be ruled out and the rule is looked for everywhere.
    """
    sets = {known for known, _ in _cut(_walk(parser.parse(pattern), {(frozenset(), "")}))}
    least = [s for s in sets if not any(t < s for t in sets)]
    return () if frozenset() in least else tuple(sorted(tuple(sorted(s)[:LONGEST]) for s in least))


WORDS = "(" + "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")]) + ")"
RULES = [
    Rule("assign", WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),  # the same runs as with + and at least 20 characters of all
    Rule("hex", "[0-9a-f]{24,}", base=True),
    # shapes that issuers of keys have made public
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", "[prs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("private_key", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("login_url", r"://[A-Za-z0-9._~%-]+:([A-Za-z0-9._~%!$&*+=-]+)@", 1, 3),
    Rule("bearer", r"[bB]earer\x20+([A-Za-z0-9+/_.~=-]+)", 1, 16),
]
