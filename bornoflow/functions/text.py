"""Text expressions over columns: scanner, sanitizer, sentences, tokenisers, grammars, skeletons. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HASANT, ZWNJ, ZWJ = "্", "‌", "‍"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
#: Base letters, and what else may stand in a Bangla word.
BASE = "অ-ঌএঐও-নপ-রলশ-হৎড়ঢ়য়-ৡ"
MARK = "ঁ-ঃ়া-ৄেৈো-্ৗৢৣ৾"
JOINER = ZWNJ + ZWJ
#: Scanner pieces: words with their phonetic signals, runs of dots, any other single character.
PIECE = r"(?:[\^:]|,,|(?<=[tT])``|[\p{IsAlphabetic}\p{N}])+|\.{2,}|[\s\S]"
SENTENCE_END = r"[।!?]+|(?<!\p{Nd})[.](?!\p{Nd})|[\r\n]+"
ALLOWED_SIGNS = "।.,;:!?'\"()[]{}<>-_+=*&^%$#@/\\|`"


def allowed_class(extra: str = "") -> str:
    """Character class of what the sanitizer lets pass: white space, ASCII letters and digits, the Bengali block, joiners, common signs."""
    return r"\s0-9A-Za-zঀ-৿।‌‍" + re.escape(ALLOWED_SIGNS + extra).replace("/", r"\/")


def is_valid(text: Column, extra: str = "") -> Column:
    return ~text.rlike(f"[^{allowed_class(extra)}]")


def clean(text: Column, extra: str = "") -> Column:
    return F.regexp_replace(text, f"[^{allowed_class(extra)}]", "")


def invalid_chars(text: Column, extra: str = "") -> Column:
    """The distinct characters the sanitizer stops, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^{allowed_class(extra)}]"), F.lit(0)))), "")


def sanitize(text: Column, extra: str = "") -> Column:
    """struct(ok, error): the text, or the characters that stop it."""
    bad = invalid_chars(text, extra)
    return F.struct(F.when(bad == "", text).alias("ok"), F.when(bad != "", bad).alias("error"))


def scan_pieces(text: Column) -> Column:
    """The scanner's pieces alone; linear in the length of the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def piece_type(p: Column) -> Column:
    return (
        F.when(p.rlike(r"^\p{N}+$"), "Number").when(p.rlike(r"^(?:[\^:]|,,|``|[\p{IsAlphabetic}\p{N}])+$"), "Word")
        .when(p.rlike(r"^[\s\p{Z}]$"), "Whitespace").when(p.rlike(r"^\.+$|^[!-#%-*,-/:;?@\[-\]_{}।]$"), "Punctuation").otherwise("Symbol")
    )


def digits(text: Column) -> Column:
    return F.translate(text, "0123456789", BENGALI_DIGITS)


def symbols(text: Column) -> Column:
    return F.translate(text, ".$", "।৳")


def sentences(text: Column) -> Column:
    """Sentences in order: split at danda, !, ?, a dot beside no digit and line ends; white space collapsed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def latin_tokens(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def normalize_bangla_word(word: Column) -> Column:
    """Joiners after a final hasant go; a final ta with hasant becomes khanda ta."""
    return F.regexp_replace(F.regexp_replace(word, f"(?<={HASANT})[{JOINER}]+$", ""), f"ত{HASANT}$", "ৎ")


def is_corpus_word(word: Column) -> Column:
    """Bangla corpus grammar: starts with a base letter; a base follows each hasant but a final one; no two joiners together, none first or last;
    a final hasant only with two base letters or more."""
    unit = f"[{BASE}]|[{MARK}&&[^{HASANT}]]|{HASANT}[{JOINER}]?(?=[{BASE}])|{HASANT}$|[{JOINER}](?=[{BASE}{MARK}])"
    whole = word.rlike(f"^[{BASE}](?:{unit})*$")
    return whole & ~(word.rlike(f"{HASANT}$") & ~word.rlike(f"[{BASE}].*[{BASE}]"))


def is_lexicon_word(word: Column) -> Column:
    """Bangla lexicon grammar: as the corpus grammar, but no final hasant at all."""
    return is_corpus_word(word) & ~word.rlike(f"{HASANT}$")


def is_loose_bangla(word: Column) -> Column:
    """Bengali block and joiners only, with a letter among them."""
    return word.rlike(f"^[ঀ-৿{JOINER}]+$") & word.rlike(f"[{BASE}]")


def bangla_tokens(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{BASE}{MARK}{JOINER}ৰৱ]+"), F.lit(0))
    return F.filter(F.transform(runs, normalize_bangla_word), is_corpus_word)


def is_clean_roman(word: Column) -> Column:
    return word.rlike(r"^[A-Za-z,`/]+$") & word.rlike("[A-Za-z]")


def is_loanword_key(word: Column) -> Column:
    return word.rlike("^[a-z0-9]+$")


def loanword_key(text: Column) -> Column:
    """The query key: lower-cased, or null where other than ASCII letters and digits stand in it."""
    return F.when(text.rlike("^[A-Za-z0-9]+$"), F.lower(text))


def bangla_units(word: Column) -> Column:
    """Grapheme-like units: a base with its marks, hasant joining bases."""
    return F.regexp_extract_all(word, F.lit(f"[{BASE}](?:{HASANT}[{JOINER}]?[{BASE}]|[{MARK}{JOINER}])*|[\\s\\S]"), F.lit(0))




def phonetic_skeleton(word: Column) -> Column:
    """Consonants alone, folded by series, neighbours of one kind collapsed."""
    folded = F.translate(word, "খঘছঝঠঢথধফভশষণঞঙযড়ঢ়য়ৎ", "কগচজটডতদপবসসনননজররজত")
    return F.regexp_replace(F.regexp_replace(folded, "[^ক-হ]", ""), r"(.)\1+", "$1")


def consonant_skeleton(word: Column) -> Column:
    """Consonants alone, with only letters of identical sound folded."""
    folded = F.translate(F.regexp_replace(word, "য়", "য়"), "শষণযৎ", "সসনজত")
    return F.regexp_replace(folded, "[^ক-হড়ঢ়য়]", "")


def english_skeleton(word: Column) -> Column:
    """A rough consonant skeleton of an English key: digraphs to one sound, vowels dropped, doubles collapsed."""
    out = F.lower(word)
    for letters, sound in (("ph", "f"), ("gh", "g"), ("ck", "k")):
        out = F.replace(out, F.lit(letters), F.lit(sound))
    out = F.regexp_replace(out, "sch|sh|ch", "s")
    for letters, sound in (("th", "t"), ("qu", "kw"), ("x", "ks"), ("ce", "se"), ("ci", "si"), ("cy", "sy")):
        out = F.replace(out, F.lit(letters), F.lit(sound))
    return F.regexp_replace(F.translate(out, "cqzvaeiouyhw", "kkjb"), r"(.)\1+", "$1")


def without_nasal_or_breath(word: Column) -> Column:
    return F.regexp_replace(word, "[ঁঃ]", "")


def same_but_nasal_or_breath(a: Column, b: Column) -> Column:
    return (a != b) & (without_nasal_or_breath(a) == without_nasal_or_breath(b))


def same_but_vowel_length(a: Column, b: Column) -> Column:
    fold = lambda x: F.translate(x, "ঈঊীূ", "ইউিু")
    return (a != b) & (fold(a) == fold(b))


def trim_token(token: Column) -> Column:
    """A raw context token without surrounding punctuation."""
    return F.regexp_replace(token, r"^[\p{P}\p{S}\s।]+|[\p{P}\p{S}\s।]+$", "")


def ends_sentence(token: Column) -> Column:
    return token.rlike(r"[।.!?][\"')\]}\s]*$")


_NAME_END = r"(?:[\s/][^>]*)?>"
_SKIPPED = rf"(?is)<\s*(?:[^\s/>:]*:)?(script|style){_NAME_END}.*?"
_CLOSED = rf"<\s*/\s*(?:[^\s/>:]*:)?\1{_NAME_END}"
#: What a page is cut into: tags, an unclosed tag to the end, what may be an entity, other text.
HTML_PIECE = r"<[^>]*>|<[\s\S]*|&[^;]{0,32};|&|[^<&]+"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decoded_entity(name: Column) -> Column:
    """The character of an entity's name; a space for names that aren't known and numbers that are no character."""
    hexed = F.conv(F.nullif(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,8})$", 1), F.lit("")), 16, 10)
    n = F.coalesce(hexed, F.nullif(F.regexp_extract(name, "^#([0-9]{1,10})$", 1), F.lit(""))).cast("long")
    valid = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(" ")
    for known, char in ENTITIES.items():
        out = F.when(name == known, char).otherwise(out)
    return out


def html_to_text(html: Column) -> Column:
    """Script and style bodies dropped, each tag a space (an unclosed one drops the rest), entities decoded.

    An ampersand takes all up to the next semicolon within 32 bytes for an entity: one of six names, a number in decimal or
    hexadecimal, or else a space; without such a semicolon it is a space itself."""
    out = F.regexp_replace(F.regexp_replace(html, _SKIPPED + _CLOSED, "<><>"), _SKIPPED + r"\z", "<>")
    entity = lambda p: F.when(F.octet_length(p) <= 34, decoded_entity(F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(F.concat(F.lit(" "), F.substring(p, F.lit(2), F.length(p))))
    piece = lambda p: F.when(p.startswith("<"), F.when(p.endswith(">"), " ").otherwise("")).when(p == "&", " ").when(p.startswith("&"), entity(p)).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(out, F.lit(HTML_PIECE), F.lit(0)), piece), "")


#: Signs of a broken word: doubled vowel signs, a doubled vowel at the start, pairs that no word has.
CORRUPT = "াা|িি|ীী|ুু|ূূ|েে|ৈৈ|োো|ৌৌ|^(?:অঅ|আআ|ইই|উউ|এএ|ওও)|ক্সজ|জন্দ্রিয়া|হাে|ুূ|ূু|িী|ীি"


def has_corrupt_shape(word: Column) -> Column:
    return word.rlike(CORRUPT)


def is_personal_text(text: Column) -> Column:
    """A word that a personal store may learn as text: at most 72 bytes of the Bengali block, without danda and taka, with a letter."""
    return (F.octet_length(text) <= 72) & text.rlike("^[ঀ-৲৴-৿]+$") & text.rlike(r"[\x{0985}-\x{09B9}\x{09CE}\x{09DC}-\x{09DF}]")


def deletions(word: Column) -> Column:
    """The word with each one of its characters left out, distinct."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def transpositions(word: Column) -> Column:
    """The word with each pair of neighbouring characters exchanged, distinct and other than the word."""
    at = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    swapped = F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))
    return F.filter(F.array_distinct(swapped), lambda x: x != word)
