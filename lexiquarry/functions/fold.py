"""Case and accent folding as native ``translate`` expressions.

Every map is a function of single characters, generated from one Unicode table, so the same literal serves
Spark plans and SQL. No Python runs on the executors and expressions stay in generated code."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_char(c: str) -> str:
    """Simple lower case of one character; kept where it would become several."""
    low = c.lower()
    return low if len(low) == 1 else {"İ": "i"}.get(c, c)


def fold_char(c: str) -> str:
    """What the folded reading compares: '' for a nonspacing mark, else the lower case without its marks."""
    if unicodedata.category(c) == "Mn":
        return ""
    low = lower_char(c)
    first, *rest = unicodedata.normalize("NFD", low)
    return first if all(unicodedata.category(x) == "Mn" for x in rest) else low


def latin_char(c: str) -> str:
    """Full-text folding: lower case, and only Latin letters lose their marks."""
    if unicodedata.category(c) == "Mn":
        return "" if "COMBINING" in unicodedata.name(c, "") else c
    low = lower_char(c)
    first = unicodedata.normalize("NFD", low)[0]
    return fold_char(c) if "LATIN" in unicodedata.name(first, "") or first.isascii() else low


def upper_char(c: str) -> str:
    """Simple upper case of one character; kept where it would become several."""
    up = c.upper()
    return up if len(up) == 1 else c


def _characters():
    for i in range(1, sys.maxunicode + 1):
        if not 0xD800 <= i <= 0xDFFF:
            c = chr(i)
            if unicodedata.category(c)[0] in "LMN":
                yield c


@cache
def tables(kind: str) -> tuple[str, str]:
    """Source and target of translate; source characters beyond the target are dropped."""
    change = {"fold": fold_char, "lower": lower_char, "latin": latin_char, "upper": upper_char}[kind]
    mapped, dropped = [], []
    for c in _characters():
        to = change(c)
        if to == "":
            dropped.append(c)
        elif to != c:
            mapped.append((c, to))
    return "".join(c for c, _ in mapped) + "".join(dropped), "".join(t for _, t in mapped)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CAPITAL = r"[\p{Lu}\p{Lt}]"
NOT_CAPITAL = r"[^\p{Lu}\p{Lt}]"


def fold(c: Column | str) -> Column:
    return F.translate(c, *tables("fold"))


def lower1(c: Column | str) -> Column:
    return F.translate(c, *tables("lower"))


def upper1(c: Column | str) -> Column:
    return F.translate(c, *tables("upper"))


def latin(c: Column | str) -> Column:
    return F.translate(c, *tables("latin"))


def nocase(c: Column | str) -> Column:
    """ASCII letters lower-cased, all others as they are."""
    return F.translate(c, _UPPER, _LOWER)


def capmask(c: Column | str) -> Column:
    """1 for a capital and 0 for anything else, character by character: small letters sort first."""
    return F.regexp_replace(F.regexp_replace(c, NOT_CAPITAL, "0"), CAPITAL, "1")


def collation(c: Column | str) -> list[Column]:
    """Sort keys of dictionary order: letters, then accents, then case, then bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return [fold(c), lower1(c), capmask(c), c]


def fold_text(s: str) -> str:
    return "".join(map(fold_char, s))


def lower_text(s: str) -> str:
    return "".join(map(lower_char, s))


def nocase_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def translate_sql(expression: str, kind: str) -> str:
    """translate in SQL; texts of ASCII alone take the ASCII part of the table, which is read far faster."""
    source, target = (_UPPER, _LOWER) if kind == "nocase" else tables(kind)
    whole = f"translate({expression}, {quoted(source)}, {quoted(target)})"
    if source.isascii():
        return whole
    mapped = [(c, t) for c, t in zip(source, target) if c.isascii()]
    dropped = "".join(c for c in source[len(target) :] if c.isascii())
    small = f"translate({expression}, {quoted(''.join(c for c, _ in mapped) + dropped)}, {quoted(''.join(t for _, t in mapped))})"
    return f"CASE WHEN strlen({expression}) = length({expression}) THEN {small} ELSE {whole} END"


def capmask_sql(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '{NOT_CAPITAL}', '0', 'g'), '{CAPITAL}', '1', 'g')"
