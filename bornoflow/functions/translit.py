"""Roman words to phonetic units and Bangla.

A word is cut into units by the longest rule key at each place; passes over the units then form reph, vocalic r, nasal
and ya signals, explicit and implicit conjuncts, and attach vowels; rendering follows the units. The functions are pure
Python on one word; `operators.transliteration` applies them to distinct words.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from .rules import BISARGA, CANONICAL, CHANDRABINDU, CONJUNCT_HEADS, CONJUNCTS, CONSONANTS, DIGITS, FOREIGN, HASANT, SIGNS, SYMBOLS, VOWELS, ZWNJ, canonical, conjunct_of


class Unit(NamedTuple):
    text: str
    kind: str
    position: int


def _patterns() -> dict[str, tuple[str, str]]:
    out = {"o": ("o", "TerminatingVowel"), "rr": ("rr", "SpecialForm")}
    out |= {k: (k, "ConsonantWithHasant" if v == HASANT else "SpecialForm") for k, v in SIGNS.items()}
    out |= {k: (k, "Symbol") for k in SYMBOLS} | {k: (k, "Consonant") for k in CONSONANTS}
    out |= {k: (k, "Vowel") for k in VOWELS if k != "o"} | FOREIGN
    swapped = {k.swapcase(): v for k, v in out.items() if len(k) == 1 and k.isalpha() and k == v[0]}
    return {k: v for k, v in swapped.items() if k not in out and k != "Z"} | out


PATTERNS = _patterns()
LONGEST = max(map(len, PATTERNS))
VOWEL_KINDS = {"Vowel": "WithVowel", "TerminatingVowel": "WithTerminator"}


def _cut(word: str) -> list[Unit]:
    out, i, at = [], 0, 0  # at: the place in UTF-8 bytes
    while i < len(word):
        for n in range(min(LONGEST, len(word) - i), 0, -1):
            if (found := PATTERNS.get(word[i : i + n])) is not None:
                break
        else:
            n, c = 1, word[i]
            found = (c, "Numeral" if c in DIGITS else "Unknown")
        out.append(Unit(*found, at))
        at += len(word[i : i + n].encode())
        i += n
    return out


def _is(u: Unit | None, kind: str, *texts: str) -> bool:
    return u is not None and u.kind == kind and (not texts or u.text in texts)


def _replace(units: list[Unit], rule) -> list[Unit]:
    """One pass from the left: where rule(units, i) gives (unit, n), it stands for n units."""
    out, i = [], 0
    while i < len(units):
        hit = rule(units, i)
        if hit is None:
            out.append(units[i])
            i += 1
        else:
            out += hit[0]
            i += hit[1]
    return out


def _get(units: list[Unit], i: int) -> Unit | None:
    return units[i] if i < len(units) else None


def _khanda(u: Unit | None) -> bool:
    return _is(u, "SpecialForm", "t``", "T``")


def _reph_hasant(u, i):
    if _is(u[i], "SpecialForm", "rr") and _is(_get(u, i + 1), "ConsonantWithHasant") and (_is(_get(u, i + 2), "Consonant") or _khanda(_get(u, i + 2))):
        return [u[i]], 2


def _reph(u, i):
    nxt = _get(u, i + 1)
    if _is(u[i], "SpecialForm", "rr"):
        if _is(nxt, "Vowel", "i"):
            return [Unit("rri", "Vowel", u[i].position)], 2
        if _is(nxt, "Consonant"):
            return [Unit("rr" + nxt.text, "RephOverConsonant", u[i].position)], 2


def _velar_nasal(u, i):
    nxt = _get(u, i + 1)
    if _is(u[i], "SpecialForm", "ng") and _is(nxt, "Consonant", "g", "gh", "Gh", "GH"):
        return [Unit("Ng,," + nxt.text.lower(), "Conjunct", u[i].position)], 2


def _ra_ya(u, i):
    if _is(u[i], "Consonant", "r") and _is(_get(u, i + 1), "Unknown", "Z") and _is(_get(u, i + 2), "Consonant", "y", "Y"):
        return [Unit("rZ,,y", "Conjunct", u[i].position)], 3


def _khanda_hasant(u, i):
    if _khanda(u[i]) and _is(_get(u, i + 1), "ConsonantWithHasant") and _is(_get(u, i + 2), "Consonant"):
        return [u[i]], 2


def takes_ya(base: list[str]) -> bool:
    """Whether a ya-phola may follow these components: a consonant that bears one, after a base that can be written."""
    if not base:
        return False
    last = canonical(base[-1])
    if last not in CONSONANTS or last in ("r", "R", "Rh", "Ng", "y", "w"):
        return False
    return len(base) == 1 or conjunct_of(base) is not None


def derived(parts: list[str]) -> bool:
    return len(parts) > 0 and parts[-1] in ("y", "Y") and takes_ya(parts[:-1])


def writable(parts: list[str]) -> bool:
    return conjunct_of(parts) is not None or derived(parts)


def _base(u: Unit) -> str | None:
    return u.text[2:] or None if u.kind == "RephOverConsonant" and u.text.startswith("rr") else None


def _explicit(u, i):
    if not _is(_get(u, i + 1), "ConsonantWithHasant") or i + 2 >= len(u):
        return None
    if u[i].kind == "Consonant" or _is(u[i], "SpecialForm", "rr"):
        parts = [u[i].text]
    elif (base := _base(u[i])) is not None:
        parts = ["rr", base]
    else:
        return None
    j = i + 1
    while _is(_get(u, j), "ConsonantWithHasant") and j + 1 < len(u):
        nxt = u[j + 1]
        phola = nxt.text in ("w", "y", "Y")
        if not (nxt.kind == "Consonant" or _is(nxt, "Unknown", "w")) or (phola and not writable([*parts, nxt.text])):
            break
        parts.append(nxt.text)
        j += 2
    if j > i + 1 and len(parts) > 1 and (not {"w", "y", "Y"} & set(parts) or writable(parts)):
        return [Unit(",,".join(parts), "Conjunct", u[i].position)], j - i


def _in_run(u: Unit) -> bool:
    return u.kind in ("Consonant", "Conjunct", "RephOverConsonant") or _is(u, "SpecialForm", "rr") or _is(u, "Unknown", "w")


def _conjunct_length(u: list[Unit], start: int, end: int) -> int:
    """Units of the longest conjunct that begins at start, 0 if none."""
    best, parts, listed = 0, [], True
    for i in range(start, end):
        for part in u[i].text.split(",,"):
            parts.append(part)
            listed = listed and "".join(map(canonical, parts)) in CONJUNCT_HEADS
        n = i - start + 1
        if n > 1 and ((listed and "".join(map(canonical, parts)) in CONJUNCTS) or derived(parts)):
            best = n
        if not listed and not derived(parts) and not takes_ya(parts):
            break
    if best or (base := _base(u[start])) is None:
        return best
    tail = [base]
    for i in range(start + 1, end):
        tail += u[i].text.split(",,")
        after = _get(u, i + 1)
        if writable(tail) and not (tail[-1] == "r" and after is not None and after.kind in VOWEL_KINDS):
            best = i - start + 1
    return best


def _runs(u: list[Unit]) -> list[Unit]:
    out, i = [], 0
    while i < len(u):
        end = i
        while end < len(u) and _in_run(u[end]):
            end += 1
        if end - i < 2:
            out.append(u[i])
            i += 1
            continue
        while i < end:
            n = _conjunct_length(u, i, end)
            if n:
                parts = [p for x in u[i : i + n] for p in (["rr", _base(x)] if _base(x) else x.text.split(",,"))]
                out.append(Unit(",,".join(parts), "Conjunct", u[i].position))
            else:
                out.append(u[i])
            i += n or 1
    return out


def _attach(u, i):
    nxt = _get(u, i + 1)
    if nxt is not None and u[i].kind in ("Consonant", "Conjunct", "RephOverConsonant") and nxt.kind in VOWEL_KINDS:
        return [Unit(u[i].text + nxt.text, u[i].kind + VOWEL_KINDS[nxt.kind], u[i].position)], 2


def _attached_vowel(text: str) -> str | None:
    part = text.rsplit(",,", 1)[-1]
    part = part[2:] if part.startswith("rr") and len(part) > 2 else part
    return next((part[n:] for n in range(1, len(part)) if part[n:] in VOWELS and (part[:n] in CONSONANTS or part[:n] == "w")), None)


def _long_iya(u, i):
    ya, w = _get(u, i + 1), _get(u, i + 2)
    if w is None or not _is(ya, "Consonant", "y", "Y") or u[i].kind not in ("ConsonantWithVowel", "ConjunctWithVowel", "RephOverConsonantWithVowel") or _attached_vowel(u[i].text) != "i":
        return None
    carried = {"ConsonantWithVowel": "Vowel", "ConsonantWithTerminator": "TerminatingVowel"}.get(w.kind)
    if not (_is(w, "Consonant", "w") or (carried and w.text.startswith("w") and len(w.text) > 1)):
        return None
    vowel = [Unit(w.text[1:], carried, w.position)] if carried else []
    return [Unit(u[i].text[:-1] + "I", u[i].kind, u[i].position), ya, *vowel], 3


def units(word: str) -> list[Unit]:
    """The phonetic units of a word, positions in UTF-8 bytes."""
    head = word.rstrip("^:")
    base = len(head.encode())
    tail = [Unit(c, "SpecialForm", base + k) for k, c in enumerate(word[len(head) :])]
    if not head:
        return tail
    u = _cut(head)
    signals = {(a.text, b.text) for a, b in zip(u, u[1:])}
    for rule in (_reph_hasant, _reph, _velar_nasal, _ra_ya, _khanda_hasant, _explicit):
        u = _replace(u, rule)
    u = _replace(_runs(u), _attach)
    if any(a in ("y", "Y") and b == "w" for a, b in signals) and (changed := _replace(u, _long_iya)) != u:
        u = _replace(changed, _attach)
    return u + tail


def _component(part: str) -> str | None:
    return {"rZ": "র" + ZWNJ, "y": "য", "Y": "য", "w": "ব"}.get(part) or CONSONANTS.get(part)


def _conjunct(parts: list[str]) -> str | None:
    if len(parts) < 2:
        return None
    if (listed := conjunct_of(parts)) is not None:
        return listed
    if parts[0] == "rr":
        rest = _conjunct(parts[1:])
        return None if rest is None else "র" + HASANT + rest
    letters = [_component(p) for p in parts]
    return None if None in letters else HASANT.join(letters)


def split_vowel(text: str) -> tuple[str, str] | None:
    """(consonant, vowel) of a syllable's text, the longest vowel first."""
    for n in range(min(3, len(text) - 1), 0, -1):
        if text[:-n] in CONSONANTS and text[-n:] in VOWELS:
            return text[:-n], text[-n:]
    return None


def _sign(vowel: str) -> str:
    return VOWELS[vowel][1] or "" if vowel in VOWELS else vowel


def _syllable(text: str) -> str:
    cut = split_vowel(text)
    return CONSONANTS[cut[0]] + _sign(cut[1]) if cut else CONSONANTS.get(text, text)


def _conjunct_syllable(u: Unit, last: bool) -> str:
    parts = u.text.split(",,")
    if len(parts) < 2:
        return u.text
    end = parts[-1]
    cut = split_vowel(end) or (("w", end[1:]) if end.startswith("w") and end[1:] in VOWELS else None)
    if cut is None:
        return (_conjunct(parts) or u.text) if u.kind == "ConjunctWithTerminator" else u.text
    body = _conjunct([*parts[:-1], cut[0]])
    if body is None:
        return u.text
    if u.kind == "ConjunctWithTerminator" and cut[1] == "o":
        return body + (VOWELS["O"][1] if last and cut[0] in ("y", "Y", "w") else "")
    return body + _sign(cut[1])


def _reph_syllable(text: str) -> str:
    cut = split_vowel(text[2:]) if text.startswith("rr") else None
    if cut is None:
        return text
    return (conjunct_of(["rr", cut[0]]) or "র" + HASANT + CONSONANTS[cut[0]]) + _sign(cut[1])


def _bears_hasant(c: str) -> bool:
    return "ক" <= c <= "হ" or c in "়ড়ঢ়য়"


def render(word: str) -> str:
    """The word in Bangla; what no rule covers stays as it is."""
    out, open_, all_units = "", False, units(word)  # open_: the unit before takes a dependent vowel
    for k, u in enumerate(all_units):
        now = False
        if u.kind == "Consonant":
            out, now = out + CONSONANTS.get(u.text, u.text), u.text in CONSONANTS
        elif u.kind in VOWEL_KINDS:
            own, sign = VOWELS.get(u.text, (u.text, None))
            out += sign if open_ and sign is not None else own
        elif u.kind in ("ConsonantWithVowel", "ConsonantWithTerminator"):
            out += _syllable(u.text)
        elif u.kind == "ConsonantWithHasant":
            out += (HASANT if not out or _bears_hasant(out[-1]) else "") if u.text == ",," else u.text
        elif u.kind == "Conjunct":
            out, now = out + (_conjunct(u.text.split(",,")) or u.text), True
        elif u.kind in ("ConjunctWithVowel", "ConjunctWithTerminator"):
            out += _conjunct_syllable(u, k + 1 == len(all_units))
        elif u.kind == "RephOverConsonant":
            letter = CONSONANTS.get(u.text[2:])
            out, now = out + (CONJUNCTS.get(u.text) or ("র" + HASANT + letter if letter else u.text)), True
        elif u.kind in ("RephOverConsonantWithVowel", "RephOverConsonantWithTerminator"):
            out += _reph_syllable(u.text)
        elif u.kind == "SpecialForm":
            out += "র" + HASANT if u.text == "rr" else SIGNS.get(u.text, u.text)
        elif u.kind == "Numeral":
            out += DIGITS.get(u.text, u.text)
        else:
            out += SYMBOLS.get(u.text, u.text)
        open_ = now
    return out


def pieces(text: str) -> list[str]:
    """The scanner's pieces of a text."""
    import regex

    return regex.findall(r"(?:[\^:]|,,|(?<=[tT])``|[\p{Alphabetic}\p{N}])+|\.{2,}|[\s\S]", text)


@functools.lru_cache(maxsize=4096)
def _numeric(c: str) -> bool:
    import regex

    return regex.fullmatch(r"\p{N}", c) is not None


@functools.cache
def _cutter():
    import regex

    return regex.compile(r"((?:[\^:]|,,|(?<=[tT])``|[\p{Alphabetic}\p{N}])+)").split, regex.compile(r"\.{2,}|[\s\S]").findall


def _rendered_word(word: str) -> str:
    return "".join(DIGITS.get(c, c) for c in word) if all(map(_numeric, word)) else render(word)


_WORDS: dict[str, str] = {}
_GAPS: dict[str, str] = {}
CACHED = 200_000  #: words, and runs between words, that a worker remembers; beyond that it starts anew


def render_text(text: str) -> str:
    """A text, piece by piece: words by rule, numbers in Bangla digits, a dot between numbers as it is, other signs by table.

    Words and what stands between them are cut in one pass, and each distinct one is rendered once.
    """
    split, singles = _cutter()
    out = split(text)  # between words, word, between words, ...
    if len(_WORDS) > CACHED or len(_GAPS) > CACHED:
        _WORDS.clear()
        _GAPS.clear()
    words, gaps, last = _WORDS, _GAPS, len(out) - 1
    for k in range(0, len(out), 2):
        gap = out[k]
        if gap and not (gap == "." and 0 < k < last and _numeric(cut[-1]) and _numeric(out[k + 1][0])):
            new = gaps.get(gap)
            if new is None:
                new = "".join(SYMBOLS.get(p, p) for p in singles(gap))
                if len(gap) < 64:
                    gaps[gap] = new
            out[k] = new
        if k < last:
            cut = out[k + 1]
            new = words.get(cut)
            if new is None:
                new = _rendered_word(cut)
                if len(cut) < 64:
                    words[cut] = new
            out[k + 1] = new
    return "".join(out)


__all__ = ["Unit", "units", "render", "render_text", "pieces", "derived", "takes_ya", "writable", "split_vowel", "CANONICAL", "BISARGA", "CHANDRABINDU"]
