"""Roman spelling repairs: what a word may have meant, cheapest kinds first."""

from __future__ import annotations

import re

from .translit import units

LIMIT = 8
CONJUNCT_KINDS = tuple(k + v for k in ("Conjunct", "RephOverConsonant") for v in ("", "WithVowel", "WithTerminator"))


def _separators(word: str) -> list[str]:
    """The word with an o put between two components of one of its conjuncts."""
    raw, places = word.encode(), set()
    for u in units(word):
        if u.kind in CONJUNCT_KINDS:
            at = u.position
            for part in u.text.split(",,")[:-1]:
                at += len(part.encode())
                if 0 < at < len(raw) and raw[at - 1 : at].isalpha() and raw[at : at + 1].isalpha():
                    places.add(at)
    return [(raw[:at] + b"o" + raw[at:]).decode() for at in sorted(places)]


def _nasals(word: str) -> list[tuple[str, int, str]]:
    out = []
    for m in re.finditer("ng", word):
        head, tail = word[: m.start()], word[m.end() :]
        if tail[:1] in tuple("iIeE"):
            kinds = [("nj", 2, "palatal_nasal_ja_from_ng"), *((x, c, "velar_nasal_from_ng") for x, c in (("Ng", 1), ("ngg", 1), ("Mg", 2)))]
            out += [(head + x + tail, c, k) for x, c, k in kinds]
            if tail[0] == "i":
                out += [(head + x + "I" + tail[1:], c, "velar_nasal_from_ng") for x, c in (("Ng", 2), ("ngg", 2), ("Mg", 3))]
    return out + [(word[: m.start()] + "nj" + word[m.end() :], 2, "palatal_nasal_ja_from_nz") for m in re.finditer("nz", word)]


def repairs(word: str, limit: int = LIMIT) -> list[tuple[str, int, str]]:
    """(text, cost, kind) of the first `limit` distinct repairs, the word itself first."""
    if not word or limit < 1:
        return []
    once = _separators(word)
    every = [(word, 0, "original"), *((t, 1, "inserted_separator_o") for t in once)]
    every += [(word[: m.start() + 1] + "o" + word[m.start() + 1 :], 1, "split_aspirated_consonant") for m in re.finditer("[kgcjtdpb]h", word)]
    every += [(word[: m.start()] + "R" + word[m.end() :], 1, "lowercase_r_to_flap") for m in re.finditer("(?<!r)r(?!r)", word)]
    every += _nasals(word) + [(t, 2, "inserted_separator_o") for a in once for t in _separators(a)]
    out: dict[str, tuple[str, int, str]] = {}
    for x in every:
        out.setdefault(x[0], x)
    return list(out.values())[:limit]
