"""Scanning of strings by C-like formats: each format becomes one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each conversion accepts (fixed values).
CONVERSIONS = {
    "d": r"[-+]?[0-9]+",
    "i": r"[-+]?(?:0[xX][0-9a-fA-F]+|[0-9]+)",
    "x": r"(?:0[xX])?[0-9a-fA-F]+",
    "o": r"[0-7]+",
    "f": r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?",
    "s": r"\S+",
}


class FormatError(ValueError):
    """A format that isn't understood."""


class IncompleteCapture(ValueError):
    """A text that the format doesn't fit."""


@dataclass(frozen=True)
class Part:
    """A piece of a format: a conversion, or text that must stand there (kind ""); white space before it is skipped if ``skips``."""

    kind: str
    text: str = ""
    width: int = 0
    star: bool = False
    skips: bool = True

    def regex(self) -> str:
        """What it takes, once and for all: like a scanner, it gives nothing back to the next part."""
        if not self.kind:
            return self.text
        if self.kind == "c":
            return rf"[\s\S]{{{self.width or 1}}}"
        return limited(self.kind, self.width) if self.width else CONVERSIONS[self.kind]


def limited(kind: str, width: int) -> str:
    """A conversion that takes ``width`` characters at most, signs, points and prefixes included; longer forms come first."""
    if kind == "s":
        return rf"\S{{1,{width}}}"
    if kind == "o":
        return rf"[0-7]{{1,{width}}}"
    hexadecimal = lambda r: rf"0[xX][0-9a-fA-F]{{1,{r - 2}}}|" if r > 2 else ""
    if kind == "x":
        return hexadecimal(width) + rf"[0-9a-fA-F]{{1,{width}}}"
    power = lambda r: (rf"(?:[eE][-+][0-9]{{1,{r - 2}}}|[eE][0-9]{{1,{r - 1}}})?" if r > 2 else rf"(?:[eE][0-9]{{1,{r - 1}}})?" if r > 1 else "")

    def unsigned(r: int) -> list[str]:
        if kind != "f":
            return [(hexadecimal(r) if kind == "i" else "") + rf"[0-9]{{1,{r}}}"]
        found = []
        for whole in range(r, -1, -1):
            rest = r - whole
            found += [rf"[0-9]{{{whole}}}\.[0-9]{{{k}}}{power(rest - 1 - k)}" for k in range(rest - 1, -1, -1) if whole or k]
            found += [rf"[0-9]{{{whole}}}{power(rest)}"] if whole else []
        return found

    return "|".join([rf"[-+](?:{x})" for x in (unsigned(width - 1) if width > 1 else [])] + unsigned(width))


def compile_format(form: str) -> list[Part]:
    """The parts of a format: %d %i %x %o %f %s %c and %%, each with a width or a star (skip)."""
    out, at = [], 0
    while at < len(form):
        c = form[at]
        if c != "%":
            out.append(Part("", "" if c.isspace() else re.escape(c), skips=c.isspace()))
            at += 1
            continue
        m = re.compile(r"%(\*?)([0-9]*)([a-zA-Z%])").match(form, at)
        if not m:
            raise FormatError(form)
        star, width, kind = m.groups()
        at = m.end()
        if kind == "%":
            out.append(Part("", "%"))
        elif kind == "c" or kind in CONVERSIONS:
            out.append(Part(kind, width=int(width or 0), star=bool(star), skips=kind != "c"))
        else:
            raise FormatError(f"%{kind}")
    return out


def convert(kind: str, text: str) -> int | float | str:
    if kind == "d":
        return int(text)
    if kind == "i":
        sign, body = (-1 if text[0] == "-" else 1), text.lstrip("+-")
        return sign * int(body, 16 if body[:2].lower() == "0x" else 8 if len(body) > 1 and body[0] == "0" else 10)
    if kind == "x":
        return int(text, 16)
    if kind == "o":
        return int(text, 8)
    return float(text) if kind == "f" else text


def pattern_of(parts: list[Part]) -> str:
    """One regular expression with a group for each conversion that isn't skipped."""
    return "".join((r"\s*" if p.skips else "") + (f"(?>{p.regex()})" if p.star or not p.kind else f"((?>{p.regex()}))") for p in parts)


def sscanf(text: str, form: str) -> tuple:
    """Values from the start of a text; an error if it doesn't fit."""
    parts = compile_format(form)
    m = re.match(pattern_of(parts), text)
    if not m:
        raise IncompleteCapture(f"{text!r} doesn't fit {form!r}")
    kinds = [p.kind for p in parts if p.kind and not p.star]
    return tuple(convert(k, g) for k, g in zip(kinds, m.groups(), strict=True))


def scan_columns(text: Column, form: str) -> list[Column]:
    """The same in columns: one for each conversion, null where a text doesn't fit."""
    parts = compile_format(form)
    pattern, kinds = pattern_of(parts), [p.kind for p in parts if p.kind and not p.star]
    out = []
    for k, kind in enumerate(kinds):
        got = F.when(text.rlike("^" + pattern), F.regexp_extract(text, "^" + pattern, k + 1))
        base = {"x": 16, "o": 8}.get(kind)
        if base:
            got = F.conv(F.regexp_replace(got, "^0[xX]", ""), base, 10).try_cast("long")
        elif kind == "d":
            got = got.try_cast("long")
        elif kind == "f":
            got = got.try_cast("double")
        elif kind == "i":
            body = F.regexp_replace(got, "^[-+]", "")
            size = F.when(body.rlike("^0[xX]"), F.conv(F.substring(body, 3, 20), 16, 10)).when(body.rlike("^0[0-7]+$"), F.conv(body, 8, 10)).otherwise(body).try_cast("long")
            got = F.when(got.startswith("-"), -size).otherwise(size)
        out.append(got)
    return out
