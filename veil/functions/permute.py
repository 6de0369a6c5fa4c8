"""Format-preserving permutations: distinct originals get distinct stand-ins, value by value and without a shuffle.

A number below a * b is a pair of digits in bases a and b. An alternating Feistel network adds a keyed hash of one
digit to the other, modulo its base, and swaps roles in every round. Each round can be undone, so the whole is a
permutation of [0, a * b) for any key: no two originals meet, as long as there are no more originals than
stand-ins. Domains are products by construction, so there is no walk out of them and back.

The functions give SQL text over a column or lambda variable, like the other stand-ins.
"""

from __future__ import annotations

from veil.functions import hashing as H
from veil.functions.spans import let

ROUNDS = 8
BLOCK = 36  # digits in one permutation: two halves of at most 18, each a BIGINT


def keyed(value: str, domain: str, step: str, salt: str) -> str:
    """60 bits that depend on key, domain, round and value."""
    text = f"concat({domain}, ':', CAST({step} AS STRING), ':', CAST({value} AS STRING))"
    return f"CAST(conv(substr({H.digest(text, salt)}, 1, 15), 16, 10) AS BIGINT)"


def feistel(left: str, right: str, a: str, b: str, domain: str, salt: str = "") -> str:
    """The permuted pair, ``struct<l, r>``, of ``left`` below ``a`` and ``right`` below ``b`` (at most 10^18 each)."""
    state = "struct<l:bigint,r:bigint>"
    return f"""aggregate(sequence(1, {ROUNDS}), CAST(struct({left} AS l, {right} AS r) AS {state}),
        (s, i) -> CAST(IF(i % 2 = 1,
            struct((s.l + {keyed('s.r', domain, 'i', salt)} % {a}) % {a} AS l, s.r AS r),
            struct(s.l AS l, (s.r + {keyed('s.l', domain, 'i', salt)} % {b}) % {b} AS r)) AS {state}))"""


def permuted_run(digits: str, salt: str = "") -> str:
    """A string of 1 to 36 digits as another of the same length; leading zeros count."""
    half = f"length({digits}) div 2"
    ends = f"struct(coalesce(try_cast(substr({digits}, 1, CAST({half} AS INT)) AS BIGINT), 0L) AS l, CAST(substr({digits}, CAST({half} AS INT) + 1) AS BIGINT) AS r, CAST({half} AS INT) AS nl, length({digits}) - CAST({half} AS INT) AS nr)"
    # 10^n as text, so that it stays exact
    a, b = "CAST(rpad('1', d.nl + 1, '0') AS BIGINT)", "CAST(rpad('1', d.nr + 1, '0') AS BIGINT)"
    body = feistel("d.l", "d.r", a, b, "CAST(d.nl + d.nr AS STRING)", salt)
    shown = "concat(IF(d.nl = 0, '', lpad(CAST(p.l AS STRING), d.nl, '0')), lpad(CAST(p.r AS STRING), d.nr, '0'))"
    return let(ends, "d", let(body, "p", shown))


def permute_digits(text: str, salt: str = "") -> str:
    """``text`` with its digits 0-9 permuted as a whole; all other characters stay where they are.

    Two texts of the same pattern get the same result only if they are equal. Runs of more than 36 digits are
    permuted in blocks of 36. Null stays null, a text without digits stays as it is. A single digit is only shifted,
    so texts with few digits are distinct but not well hidden.
    """
    # the column is read outside all lambdas, so its name cannot meet a bound variable
    both = f"struct(split({text}, '[0-9]', -1) AS gaps, regexp_replace({text}, '[^0-9]', '') AS digits)"
    blocks = f"transform(sequence(1, length(t.digits), {BLOCK}), o -> substr(t.digits, o, {BLOCK}))"
    stream = f"array_join(transform({blocks}, q -> {permuted_run('q', salt)}), '')"
    placed = "array_join(transform(t.gaps, (g, i) -> concat(g, substr(z, i + 1, 1))), '')"
    return f"IF(rlike({text}, '[0-9]'), {let(both, 't', let(stream, 'z', placed))}, {text})"


def permute_person(number: str, salt: str = "", last_names: int = 1_000_000) -> str:
    """A full name for a number from 0 below 1024 million: no two numbers get the same name.

    First name and last name with a numeral come from a pool of 32 * 32 * ``last_names`` names; a number outside
    it, or null, has no name here (null), so a caller sees that the pool is too small.
    """
    firsts, lasts = len(H.FIRST_NAMES), len(H.LAST_NAMES) * last_names
    pair = feistel(f"{number} % {firsts}", f"{number} div {firsts}", f"{firsts}L", f"{lasts}L", f"'person{lasts}'", salt)
    name = f"""concat({H.choose(H.FIRST_NAMES, 'p.l')}, ' ', {H.choose(H.LAST_NAMES, 'p.r')},
        IF(p.r < {len(H.LAST_NAMES)}, '', concat(' ', CAST(p.r div {len(H.LAST_NAMES)} AS STRING))))"""
    return f"IF({number} >= 0 AND {number} < {firsts * lasts}, {let(pair, 'p', name)}, NULL)"
