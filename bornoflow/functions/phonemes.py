"""Consonants as bundles of features, and how far they are apart."""

from __future__ import annotations

#: Place: step along the mouth.
PLACES = {"labial": 0, "dental": 1, "alveolar": 2, "postalveolar": 3, "palatal": 4, "velar": 5, "glottal": 6}
OBSTRUENTS = {"stop": 0, "affricate": 1, "fricative": 2}  #: their distance is that of their numbers
#: (place, manner): letters voiceless plain, voiceless aspirated, voiced plain, voiced aspirated; several with one sound in one group.
_GRID = {
    ("velar", "stop"): "ক খ গ ঘ", ("palatal", "affricate"): "চ ছ জয ঝ", ("postalveolar", "stop"): "ট ঠ ড ঢ", ("dental", "stop"): "তৎ থ দ ধ", ("labial", "stop"): "প ফ ব ভ",
    ("velar", "nasal"): "- - ঙ", ("palatal", "nasal"): "- - ঞ", ("alveolar", "nasal"): "- - নণ", ("labial", "nasal"): "- - ম", ("alveolar", "rhotic"): "- - র", ("alveolar", "lateral"): "- - ল",
    ("postalveolar", "rhotic"): "- - ড়ঢ়", ("palatal", "approximant"): "- - য়", ("postalveolar", "fricative"): "শষ", ("alveolar", "fricative"): "স", ("glottal", "fricative"): "- - হ",
}
PHONEMES = {c: (PLACES[place], manner, i > 1, i % 2) for (place, manner), row in _GRID.items() for i, cell in enumerate(row.split()) for c in cell if c != "-"}
#: Letters that a confusion may put in another's place.
PLAIN = [c for c in sorted(PHONEMES) if "ক" <= c <= "হ"]


def manner_steps(a: str, b: str) -> int:
    if a == b:
        return 0
    if a in OBSTRUENTS and b in OBSTRUENTS:
        return abs(OBSTRUENTS[a] - OBSTRUENTS[b])
    return 4 if (a in OBSTRUENTS) != (b in OBSTRUENTS) else 2


def distance(a: str, b: str) -> int | None:
    """2 per place step, 3 per manner step, 2 for voice, 1 for breath; None if either is no consonant."""
    if a not in PHONEMES or b not in PHONEMES:
        return None
    (p, m, v, h), (q, n, w, k) = PHONEMES[a], PHONEMES[b]
    return 2 * abs(p - q) + 3 * manner_steps(m, n) + 2 * (v != w) + (h != k)


def near(limit: int = 4) -> list[tuple[str, str, int]]:
    """(letter, other, distance) of all plain letters within a distance of each consonant."""
    return [(a, b, distance(a, b)) for a in sorted(PHONEMES) for b in PLAIN if a != b and distance(a, b) <= limit]
