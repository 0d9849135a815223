"""What a text must hold for a pattern to match in one of its lines: a formula of literals.

A search looks for the formula in whole texts, which is one pass of a fast string search, before it cuts texts into lines and
runs the pattern on each. The formula follows from the pattern alone: a literal run must be there; of an alternation one of
the branches must; what may be left out, or stands for many characters, asks for nothing. A text with a matching line always
satisfies it; one without may too.

In patterns that ignore case literals are folded, and so is the text. Characters whose folds are not one to one ask for nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger classes of characters ask for nothing.
MOST_OF_CLASS = 16
#: Of the literals that must all be there, the longest so many are looked for; alternations with more branches ask for nothing.
MOST_ALL, MOST_ANY = 4, 32
#: A repeated character is written out so often at most.
MOST_COPIES = 20


@dataclass(frozen=True)
class Literal:
    text: str
    fold: bool = False


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


Formula = Literal | AllOf | AnyOf | None

_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:P?<\w+>|([imsU]*)(?:-([imsU]+))?([:)]))")
_NUMBER = re.compile(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2})")
_CONTROL = {"a": "\x07", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\x0b"}
_DIGITS = tuple("0123456789")


def folded(c: str) -> str | None:
    """The one form to which a character folds, or None if its folds are not one to one."""
    up = c.upper()
    if len(up) != 1 or len(c.lower()) != 1 or up.lower() != c.lower() or c in "Σσς":
        return None
    return up.lower()


#: Small letters that fold to another small letter, and the capital that becomes two characters in lower case.
_OTHERS = {c: c.upper().lower() for c in map(chr, range(0x250, 0x2C00)) if len(c.upper()) == 1 == len(c.upper().lower()) and c.upper().lower() != c.lower()}
_OTHERS |= {c: c.upper().lower() for c in "ſıµ"} | {"İ": "i"}


def fold_text(text: Column) -> Column:
    """A text with every character in the form that folded() gives."""
    return F.lower(F.translate(text, "".join(_OTHERS), "".join(_OTHERS.values())))


class _Parser:
    """Patterns are valid: translate() has refused all others."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def alternation(self) -> tuple[Formula, tuple[Literal, ...] | None]:
        """The formula up to a closing bracket, and the characters if that is all it can match."""
        fold, branches = self.fold, []
        while True:
            branches.append(self.sequence())
            if self.p[self.i : self.i + 1] != "|":
                break
            self.i += 1
        self.fold = fold
        if len(branches) == 1:
            return branches[0]
        formulas = [f for f, _ in branches]
        if any(f is None for f in formulas) or len(formulas) > MOST_ANY:
            return None, None
        return AnyOf(tuple(dict.fromkeys(formulas))), None

    def sequence(self) -> tuple[Formula, tuple[Literal, ...] | None]:
        parts: list[Formula] = []
        run: list[Literal] = []
        exact = True  # so far, nothing but the run

        def flush() -> None:
            for k, c in enumerate(run):
                if k and run[k - 1].fold == c.fold:
                    parts[-1] = Literal(parts[-1].text + c.text, c.fold)
                else:
                    parts.append(c)
            run.clear()

        while self.i < len(self.p) and self.p[self.i] not in "|)":
            chars, formula = self.atom()
            low, high = self.quantifier()
            if chars == () and formula is None and (low, high) == (1, 1):
                continue  # a place, such as the edge of a word
            if chars is not None and low == high and low * len(chars) <= MOST_COPIES:
                run += chars * low
                continue
            exact = False
            if chars is not None and low:
                run += chars * min(low, max(1, MOST_COPIES // max(1, len(chars))))
            flush()
            if chars is None and low and formula is not None:
                parts.append(formula)
        if exact:
            whole = tuple(run)
            flush()
            return _all(parts), whole
        flush()
        return _all(parts), None

    def char(self, c: str) -> tuple[tuple[Literal, ...] | None, Formula]:
        if not self.fold:
            return (Literal(c),), None
        low = folded(c)
        return ((Literal(low, True),), None) if low is not None else (None, None)

    def quantifier(self) -> tuple[int, int | None]:
        c = self.p[self.i : self.i + 1]
        low, high = 1, 1
        if c and c in "*+?":
            self.i += 1
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif c == "{" and (m := _REPEAT.match(self.p, self.i)):
            self.i = m.end()
            low = int(m[1])
            high = low if not m[2] else int(m[3]) if m[3] else None
        else:
            return low, high
        if self.p[self.i : self.i + 1] == "?":
            self.i += 1
        return low, high

    def atom(self) -> tuple[tuple[Literal, ...] | None, Formula]:
        """Its characters, if it can match nothing else, and its formula."""
        c = self.p[self.i]
        if c == "\\":
            return self.escape()
        if c == "[":
            return self.char_class()
        if c == "(":
            m = _GROUP.match(self.p, self.i)
            outer = self.fold
            if m and m[3]:
                self.fold = (self.fold or "i" in m[1]) and "i" not in (m[2] or "")
                self.i = m.end()
                if m[3] == ")":  # flags for the rest of the group
                    return (), None
            else:
                self.i = m.end() if m else self.i + 1
            formula, chars = self.alternation()
            self.i += 1
            self.fold = outer
            return chars, formula
        self.i += 1
        if c in "^$":
            return (), None
        if c == ".":
            return None, None
        return self.char(c)

    def escape(self) -> tuple[tuple[Literal, ...] | None, Formula]:
        c = self.p[self.i + 1]
        self.i += 2
        if c == "Q":
            end = self.p.find(r"\E", self.i)
            text = self.p[self.i : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            found = [self.char(x)[0] for x in text]
            return (sum(found, ()), None) if None not in found else (None, None)
        if c in "bBAz":
            return (), None
        if c == "d":
            return None, AnyOf(tuple(map(Literal, _DIGITS)))
        if c in _CONTROL:
            return self.char(_CONTROL[c])
        if m := _NUMBER.match(self.p, self.i - 1):
            self.i = m.end()
            return self.char(chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)))
        if c in "pP":
            m = re.compile(r"\{[^}]*\}|\w").match(self.p, self.i)
            self.i = m.end()
            return None, None
        return (None, None) if c.isalnum() else self.char(c)

    def char_class(self) -> tuple[tuple[Literal, ...] | None, Formula]:
        """A class of few characters asks for one of them."""
        m = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\[pP](?:\{[^}]*\}|\w)|\\x\{[^}]*\}|\\.|[^\]\\])*\]", re.DOTALL).match(self.p, self.i)
        inner, self.i = self.p[self.i + 1 : m.end() - 1], m.end()
        if inner == "[:digit:]":
            return None, AnyOf(tuple(map(Literal, _DIGITS)))
        if inner.startswith("^") or "\\" in inner or "[:" in inner:
            return None, None
        chars: list[str] = []
        k = 0
        while k < len(inner):
            if inner[k + 1 : k + 2] == "-" and k + 2 < len(inner):
                a, b = ord(inner[k]), ord(inner[k + 2])
                if b - a >= MOST_OF_CLASS:
                    return None, None
                chars += map(chr, range(a, b + 1))
                k += 3
            else:
                chars.append(inner[k])
                k += 1
        found = [self.char(c)[0] for c in dict.fromkeys(chars)]
        if None in found or not 0 < len(found) <= MOST_OF_CLASS:
            return None, None
        if len(found) == 1:
            return found[0], None
        return None, AnyOf(tuple(dict.fromkeys(x[0] for x in found)))


def _all(parts: list[Formula]) -> Formula:
    found = [p for p in dict.fromkeys(parts) if p is not None and p != Literal("")]
    if len(found) > MOST_ALL:
        found = sorted(found, key=lambda p: -len(p.text) if isinstance(p, Literal) else 0)[:MOST_ALL]
    return None if not found else found[0] if len(found) == 1 else AllOf(tuple(found))


def required(pattern: str, ignore_case: bool = False) -> Formula:
    """The formula of a valid pattern, or None if nothing in particular must be there."""
    return _Parser(pattern, ignore_case).alternation()[0]


def _literals(formula: Formula) -> list[Literal]:
    return [formula] if isinstance(formula, Literal) else [x for p in formula.parts for x in _literals(p)]


def satisfied(text: str, formula: Formula) -> bool:
    """The formula on one text, for small lists of texts and for tests."""
    if formula is None:
        return True
    if isinstance(formula, Literal):
        return formula.text in (text.translate(str.maketrans(_OTHERS)).lower() if formula.fold else text)
    return (all if isinstance(formula, AllOf) else any)(satisfied(text, p) for p in formula.parts)


def may_match(text: Column, formula: Formula) -> Column:
    """The formula as a condition on a text."""
    if formula is None:
        return F.lit(True)

    def condition(f: Formula, plain: Column, low: Column) -> Column:
        if isinstance(f, Literal):
            return F.contains(low if f.fold else plain, F.lit(f.text))
        if isinstance(f, AnyOf) and all(isinstance(p, Literal) and len(p.text) == 1 for p in f.parts) and len({p.fold for p in f.parts}) == 1:
            return F.rlike(low if f.parts[0].fold else plain, F.lit("[" + "".join(f"\\x{{{ord(p.text):X}}}" for p in f.parts) + "]"))
        parts = [condition(p, plain, low) for p in f.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(f, AllOf) else out | p
        return out

    if not any(x.fold for x in _literals(formula)):
        return condition(formula, text, text)
    # Through an array, so that the text is folded once.
    return F.element_at(F.transform(F.array(fold_text(text)), lambda low: condition(formula, text, low)), 1)
