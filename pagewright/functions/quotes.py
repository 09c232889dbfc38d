"""Quotation signs of a text: pairs by a stack, elided apostrophes set aside first, and the systems that a page mixes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex


class System(NamedTuple):
    name: str
    opener: str
    closer: str
    languages: tuple[str, ...]


# Systems of quotation signs with the languages they are right in; of those that share an opener the page's language decides, else the first.
SYSTEMS = (
    System("German-double", "„", "“", ("de",)),
    System("Guillemet", "«", "»", ("fr",)),
    System("English-double", "“", "”", ("en",)),
    System("Slavic-double", "„", "”", ("pl", "ro", "bg", "cs")),
    System("Heavy", "❝", "❞", ()),
    System("German-single", "‚", "’", ("de",)),
    System("English-single", "‘", "’", ("en",)),
    System("Angle-single", "‹", "›", ("fr",)),
)
STRAIGHT = System("Straight", '"', '"', ())
DOUBLE = {"German-double", "Guillemet", "English-double", "Slavic-double", "Heavy"}
# What an apostrophe stands before (suffixes) and after (prefixes) when letters are left out, by language.
SUFFIXES = {"en": "s t d ll ve re m", "de": "s n ne ner nem nen mal", "nl": "s t n", "pl": "a ego emu em ie ów owi", "tr": "de da te ta den dan ten tan e a ye ya in ın un ün nin nın nun nün i ı u ü yi yı yu yü ler lar le la"}
PREFIXES = {"fr": "l d n s j m t c qu lorsqu puisqu quoiqu jusqu", "it": "l un dell sull all dall nell c dov quell sant anch tutt mezz", "pt": "d n", "ca": "l d n s m t"}
APOSTROPHES = {"tr": "’ʼ", "uk": "’ʼ"}
FINAL_S = {"en"}

_OPENERS = {s.opener for s in SYSTEMS}
_CLOSERS = {s.closer for s in SYSTEMS}
_SIGNS = regex.compile("[" + "".join(sorted(_OPENERS | _CLOSERS)) + '"]')


@lru_cache(maxsize=64)
def _elided(language: str):
    """The apostrophes of a language that stand for letters left out."""
    a = f"[{APOSTROPHES.get(language, '’')}]"
    forms = [rf"(?<=\p{{L}}){a}(?=\p{{L}})"]
    if language in SUFFIXES:
        forms.append(rf"{a}(?=(?:{'|'.join(SUFFIXES[language].split())})(?!\p{{L}}))")
    if language in PREFIXES:
        forms.append(rf"(?<=(?<!\p{{L}})(?:{'|'.join(PREFIXES[language].split())})){a}(?=\p{{L}})")
    return regex.compile("|".join(forms), regex.IGNORECASE)


@lru_cache(maxsize=64)
def _opened(sign: str, language: str) -> System:
    fit = [s for s in SYSTEMS if s.opener == sign]
    return next((s for s in fit if language in s.languages), fit[0])


class Issue(NamedTuple):
    kind: str
    at: int
    sign: str


def pairing(text: str, language: str) -> tuple[list[Issue], list[tuple[System, int]]]:
    """What is wrong with the pairs of a block, and the systems it opens with their places."""
    aside = {m.start() for m in _elided(language).finditer(text)}
    stack: list[tuple[System, int]] = []
    out, opened = [], []
    for m in _SIGNS.finditer(text):
        at, sign = m.start(), m[0]
        top = stack[-1][0] if stack else None
        if at in aside:
            continue
        if sign == "’" and language in FINAL_S and text[max(at - 1, 0) : at] in ("s", "S") and not text[at + 1 : at + 2].isalpha() and not (top and top.closer == sign):
            continue
        if sign == '"':
            if top is None or (top.name not in DOUBLE and top is not STRAIGHT):
                stack.append((STRAIGHT, at))
            else:
                stack.pop()
                if top is not STRAIGHT:
                    out.append(Issue("QUOTE_MIXED_KIND", at, sign))
        elif sign in _OPENERS and not (top and top.closer == sign):
            system = _opened(sign, language)
            stack.append((system, at))
            opened.append((system, at))
        elif top is None:
            out.append(Issue("QUOTE_WRONG_OPEN", at, sign))
        else:
            stack.pop()
            if top.closer != sign:
                out.append(Issue("QUOTE_MIXED_KIND" if top is STRAIGHT else "QUOTE_WRONG_CLOSE", at, sign))
    return out + [Issue("QUOTE_UNMATCHED", at, s.opener) for s, at in stack], opened


def quote_issues(text: str, language: str = "") -> list[Issue]:
    """The pairing's issues, and a mix of double systems, placed at the first opener that the language does not sanction or, if it sanctions none, that is not of the block's first system."""
    out, opened = pairing(text, language)
    double = [(s, at) for s, at in opened if s.name in DOUBLE]
    if len({s.name for s, _ in double}) > 1:
        fine = {s.name for s, _ in double if language in s.languages} or {double[0][0].name}
        at = next(at for s, at in double if s.name not in fine)
        out.append(Issue("QUOTE_SYSTEM_MIX", at, text[at]))
    return sorted(out, key=lambda x: (x.at, x.kind))
