"""Wildcard patterns: what a query means under each reading, on the driver.

A pattern is read as typed (T), with case ignored (C) and folded (F). Its capitals and accents decide
which readings count; classes rank a key by the first reading that it satisfies, with the
spelled word before the rest."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from lexiquarry.functions.fold import fold_char, fold_text, lower_char, lower_text

TYPED, CASELESS, FOLDED = "T", "C", "F"
MAX_TOKENS = 64
ANY, ONE = object(), object()


class PatternTooLong(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """Keys that satisfy a reading get a class. kind: equal, prefix or regex."""

    rank: int
    reading: str
    kind: str
    value: str
    spelled: bool


class Pattern:
    def __init__(self, tokens: list) -> None:
        self.tokens: list = []
        for t in tokens:
            if not (t is ANY and self.tokens and self.tokens[-1] is ANY):
                self.tokens.append(t)
        letters = [t for t in self.tokens if isinstance(t, str)]
        self.capital = any(unicodedata.category(c) in ("Lu", "Lt") for c in letters)
        self.accent = any(fold_char(c) != lower_char(c) for c in letters)

    @classmethod
    def wildcard(cls, text: str) -> Pattern:
        p = cls([{"*": ANY, "?": ONE}.get(c, c) for c in text])
        if len(p.tokens) > MAX_TOKENS:
            raise PatternTooLong(f"a pattern has at most {MAX_TOKENS} characters")
        return p

    @classmethod
    def literal(cls, text: str, prefix: bool = False) -> Pattern:
        return cls([*text, *([ANY] if prefix else [])])

    def tiers(self) -> list[str]:
        return [*([TYPED] if self.capital else []), *([CASELESS] if self.accent else []), FOLDED]

    def spelled_tiers(self) -> list[str]:
        tiers = self.tiers()
        return tiers if tiers[0] == TYPED else [TYPED, *tiers]

    def spelled(self) -> str | None:
        """The word that the pattern spells when every run is empty."""
        if ANY not in self.tokens or ONE in self.tokens:
            return None
        return "".join(t for t in self.tokens if isinstance(t, str))

    def head(self, reading: str = FOLDED) -> str:
        """The literal start of the pattern under a reading: a range of keys that a scan can skip to."""
        out = ""
        for t in self.tokens:
            if not isinstance(t, str):
                break
            out += t
        return read(out, reading)

    def _body(self, reading: str) -> tuple[str, str]:
        """How the pattern tests a key under a reading."""
        letters = [t for t in self.tokens if isinstance(t, str)]
        if len(letters) == len(self.tokens):
            return "equal", read("".join(letters), reading)
        if self.tokens[-1] is ANY and len(letters) == len(self.tokens) - 1:
            return "prefix", read("".join(letters), reading)
        parts = []
        for t in self.tokens:
            parts.append(".*" if t is ANY else "." if t is ONE else re.sub(r"([^\w\s])", r"\\\1", read(t, reading), flags=re.ASCII) if read(t, reading).isascii() else read(t, reading))
        return "regex", "(?s)^(?:" + "".join(parts) + ")$"

    def rules(self) -> list[Rule]:
        """Tests in order of class; the first that a key satisfies is its class."""
        tiers = self.tiers()
        if ANY not in self.tokens and ONE not in self.tokens:
            return [Rule(i, t, *self._body(t), True) for i, t in enumerate(self.spelled_tiers())]
        word, out = self.spelled(), []
        if word is not None and tiers[0] != TYPED:
            out.append(Rule(0, TYPED, "equal", word, True))
        for t in tiers:
            if word is not None:
                out.append(Rule(len(out), t, "equal", read(word, t), True))
            out.append(Rule(len(out), t, *self._body(t), False))
        # Spelled readings come before all others when a key satisfies both.
        return [r for r in out if r.spelled] + [r for r in out if not r.spelled]


def read(text: str, reading: str) -> str:
    return {TYPED: lambda s: s, CASELESS: lower_text, FOLDED: fold_text}[reading](text)
