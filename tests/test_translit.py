"""Golden words and properties of the transliteration."""

import pytest

from bornoflow.functions import rules
from bornoflow.functions.translit import render_text, units

GOLDEN = {
    "kOI": "কৈ", "kOU": "কৌ", "boi": "বই", "bou": "বউ", "kk": "ক্ক", "kok": "কক", "kOk": "কোক", "k,,k": "ক্ক", "k,,a": "ক্আ", "kk,,": "ক্ক্",
    "rrt": "র্ত", "rrt``": "র্ৎ", "rr,,t``": "র্ৎ", "rrt``sa": "র্ৎসা", "rrkSh": "র্ক্ষ", "rrk,,Sh": "র্ক্ষ", "rrsk": "র্স্ক", "rrs,,ka": "র্স্কা",
    "ky": "ক্য", "k,,w": "ক্ব", "zya": "য্যা", "bwa": "ব্বা", "Rw": "ড়ওয়", "ply": "প্ল্য", "plYan": "প্ল্যান", "blYak": "ব্ল্যাক", "flYaT": "ফ্ল্যাট",
    "q": "ক", "qq": "ঁ", "x": "ক্স", "X": "ক্স", "w": "ওয়", "iraq": "ইরাক", "box": "বক্স", "water": "ওয়াতের", "baqq": "বাঁ",
    "kz": "কয", "kb": "কব", "zoy": "যয়", "zy": "য্য", "bw": "ব্ব", "ngg": "ঙ্গ", "sMgo": "সংগ", "songskrriti": "সংস্কৃতি", "shongkha": "শংখা",
    "songgo": "সঙ্গ", "nggho": "ঙ্ঘ", "sMgho": "সংঘ", "NGj": "ঞ্জ", "nj": "ঞ্জ", "jinjira": "জিঞ্জিরা", "noj": "নজ", "nz": "নয", "jNG": "জ্ঞ", "jn": "জ্ঞ", "gg": "জ্ঞ", "biggan": "বিজ্ঞান", "gog": "গগ",
    "tiyw": "তীয়", "kiywo": "কীয়", "kiywO": "কীয়ো", "rri": "ঋ", "krri": "কৃ", "rria": "ঋআ", "rrhi": "র্হি", "aYp": "অ্যাপ", "ayp": "আয়প", "app": "আপ্প", "kaY": "ক্যা", "kay": "কায়",
    "ii": "ইই", "oo": "অঅ", "uu": "উউ", "kaa": "কাআ", "kii": "কিই", "koo": "কঅ", "kU": "কূ", "uuupintocala": "উউউপিন্তচালা", "kia": "কিয়া", "kio": "কিও", "keo": "কেও",
    "k,,i": "ক্ই", "k^a": "কঁআ", "k:a": "কঃআ", "rZyab": "র‌্যাব", "rrYa": "র্যা", "Zya": "Zয়া", "kZya": "কZয়া", "KhA": "খা", "Chya": "ছ্যা", "jhya": "ঝ্যা", "acCHHa": "আচ্ছা",
    "Biggan": "বিজ্ঞান", "BhalO": "ভালো", "Ga": "গা", "Z": "Z", "pph": "পফ", "p,,ph": "প্ফ", "12.34": "১২.৩৪", "12.34.": "১২.৩৪।", "$": "৳", "k20": "ক২০", "a1b2": "আ১ব২", "k...": "ক...",
}


@pytest.mark.parametrize("roman", GOLDEN)
def test_golden(roman):
    assert render_text(roman) == GOLDEN[roman], units(roman)


def test_conjunct_table():
    assert len(rules.CONJUNCTS) == 448 and rules.conjunct_of(["k", "SH"]) == "ক্ষ" and rules.conjunct_of(["k"]) is None
    assert rules.components("ক্ত্র") == ["k", "t", "r"] and rules.components("x") == []
    assert len({r[0] for r in rules.rule_rows() if r[1].startswith("consonant")}) == len(rules.CONSONANTS)


def test_units_cover_the_word():
    import itertools

    for word in map("".join, itertools.product(["k", "rr", "y", "w", "a", "o", "^", ",,", "t``", "Z", "é"], repeat=3)):
        cut = units(word)
        assert [u.position for u in cut] == sorted({u.position for u in cut}) and cut[0].position == 0
        assert all(u.text for u in cut)
