"""Text helpers (FN-10..13, FIL-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ._util import col_of

# Unicode white space (the White_Space property): tab, line breaks, space,
# next-line, no-break space, ogham mark, en/em spaces .. hair space, line and
# paragraph separators, narrow no-break, medium mathematical, ideographic.
UNICODE_WS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def trim_unicode(c) -> Column:
    """Trim every Unicode white-space character from both ends (Spark's plain
    ``trim`` strips ASCII spaces only)."""
    return F.btrim(col_of(c).cast("string"), F.lit(UNICODE_WS))


def patient_hash(c) -> Column:
    """Pseudonymise a person: NULL/blank -> NULL; else first 16 hex of SHA-256
    of the trimmed UTF-8 text. The clear value is never written anywhere."""
    t = trim_unicode(c)
    return F.when(F.length(t) > 0, F.substring(F.sha2(t, 256), 1, 16))


def clip_text(c, n: int = 200) -> Column:
    """Trim and cut to n characters; NULL stays NULL."""
    return F.substring(trim_unicode(c), 1, n)


def flag_equals(c, value: str) -> Column:
    """trim(x) == value with NULL passing through as NULL."""
    return trim_unicode(c) == F.lit(value)


def classify_by_rules(c, rules, default: str) -> Column:
    """Ordered first-match of lower-cased substrings; NULL/empty -> default."""
    low = F.lower(col_of(c))
    expr = None
    for needle, label in rules:
        cond = F.instr(low, needle.lower()) > 0
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def ilike_any(c, patterns) -> Column:
    """Case-insensitive LIKE against any pattern (OR)."""
    c = col_of(c)
    return reduce(lambda a, b: a | b, [c.ilike(p) for p in patterns])
