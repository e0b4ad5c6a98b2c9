"""Rule tables of the Roman to Bangla transliteration: letters, vowels, signs, conjuncts."""

from __future__ import annotations

HASANT, CHANDRABINDU, BISARGA, KHANDA_TA, ANUSVAR, ZWNJ = "্", "ঁ", "ঃ", "ৎ", "ং", "‌"

#: Letter: its Roman keys, by the place where it is spoken.
LETTERS = {
    "velar": {"ক": "k", "খ": "kh Kh KH", "গ": "g", "ঘ": "gh Gh GH", "ঙ": "Ng"},
    "palatal": {"চ": "c", "ছ": "ch chh C Ch CH Chh CHH", "জ": "j J", "ঝ": "jh Jh JH", "ঞ": "NG"},
    "retroflex": {"ট": "T", "ঠ": "Th TH", "ড": "D", "ঢ": "Dh DH", "ণ": "N"},
    "dental": {"ত": "t", "থ": "th", "দ": "d", "ধ": "dh", "ন": "n"},
    "labial": {"প": "p", "ফ": "ph Ph PH f", "ব": "b", "ভ": "bh Bh BH v", "ম": "m"},
    "semivowel": {"য": "z", "র": "r", "ল": "l"},
    "fricative": {"শ": "sh S", "ষ": "Sh SH", "স": "s", "হ": "h"},
    "special": {"ড়": "R", "ঢ়": "Rh", "য়": "y Y", "ওয়": "w"},
}
CONSONANTS = {key: letter for group in LETTERS.values() for letter, keys in group.items() for key in keys.split()}
#: Vowel key: (independent form, dependent form or None for the inherent vowel).
VOWELS = {"o": ("অ", None)}
for _keys, _own, _sign in (
    ("a A", "আ", "া"), ("aY AY", "অ্যা", "্যা"), ("i", "ই", "ি"), ("I", "ঈ", "ী"), ("u", "উ", "ু"), ("U", "ঊ", "ূ"), ("e E", "এ", "ে"), ("O", "ও", "ো"),
    ("OI", "ঐ", "ৈ"), ("OU", "ঔ", "ৌ"), ("rri", "ঋ", "ৃ"), ("ai", "আই", "াই"), ("au", "আউ", "াউ"), ("ae", "আএ", "াএ"), ("ao", "আও", "াও"), ("ia", "ইয়া", "িয়া"), ("io", "ইও", "িও"), ("eo", "এও", "েও"),
):
    VOWELS |= {k: (_own, _sign) for k in _keys.split()}
SIGNS = {",,": HASANT, "^": CHANDRABINDU, ":": BISARGA, "t``": KHANDA_TA, "T``": KHANDA_TA, "ng": ANUSVAR, "M": ANUSVAR}
SYMBOLS = {".": "।", "$": "৳"}
DIGITS = dict(zip("0123456789", "০১২৩৪৫৬৭৮৯"))
#: Foreign letters: what they are read as, and its kind.
FOREIGN = {"qq": ("^", "SpecialForm"), "q": ("k", "Consonant"), "Q": ("k", "Consonant"), "x": ("k,,s", "Conjunct"), "X": ("k,,s", "Conjunct")}
#: Conjuncts whose key spells their letters one after the other, longest letter key first.
SPELLED = """
    DD DY Dm Dr Dw Dy JJ JY Jj Jr Jw Jy ND NN NT NY Nm Nw Ny Rg SY Sc Sl Sm Sn Sr Sw Sy TT TY Tm Tr Tw Ty bJ bY bb bd bj bl br bw by cC cY cc cw cy dY dd
    dg dm dr dv dw dy fl fr gY gl gm gn gr gw gy hN hY hl hm hn hr hw hy jJ jY jj jr jw jy kT kY kk kl km kn kr ks kt kw ky lD lT lY lf lg lk ll lm lp lv
    lw ly mY mb mf ml mm mn mp mr mv mw my nD nT nY nd nm nn ns nt nw ny pT pY pl pn pp pr ps pt py sT sY sf sk sl sm sn sp sr st sw sy tY tm tn tr tt tw
    ty vY vl vr vw vy yy zY zy DhY Dhr Dhy JJw JNG Jjh Jjw NDY NDh NDr NDy NGJ NGc NGj NTh Ngg Ngk Ngm Sch ShN ShT ShY Shf Shk Shm Shp Shw Shy bdh bhY bhl
    bhr bhw bhy cCh cCr cCw cNG cch dbh ddh ddw dgh dhY dhm dhn dhr dhw dhy dry dvr gdh ghY ghn ghr ghy gny gry jJw jNG jjh jjw kSh kTr khY khr khy ktr
    lbh lkY lky lph mbh mbr mph mpr mvr mwr nDr nTh nTr ndY ndh ndr ndw ndy ntY nth ntr ntw nty phl phr pry rrD rrJ rrN rrS rrT rrY rrc rrd rrf rrg rrh
    rrj rrk rrl rrm rrn rrp rrs rrt rrv rrw rry sTr shY shc shl shm shn shr shw shy skh skr snY sny sph spr stY sth str stw sty thY thr thw thy tmy try
    ttY tth ttr ttw tty NGch NGjh NThY NThy NggY Nggh Nggy NgkY Ngkh Ngky ShNw ShTY ShTh ShTr ShTy Shkr Shkw Shph Shpr cChh cChr cChw cchr cchw dbhr gdhr
    gdhy kShN kShY kShm kShw kShy mbhr ndhY ndhr ndhy nthr ntry rrJJ rrJY rrJj rrJy rrNY rrNy rrSY rrSh rrSw rrSy rrbh rrcY rrch rrcy rrdh rrdr rrdw rrgY
    rrgh rrgr rrgy rrhY rrhy rrjJ rrjY rrjh rrjj rrjy rrkY rrkh rrky rrmY rrmy rrph rrsh rrtY rrth rrtm rrtr rrty rrwY rrwy shch sthY sthy NgghY Ngghr
    Ngghy NgkSh NgkhY Ngkhy ShThY ShThy cChhr cChhw kShmy rrDhY rrDhy rrJNG rrNgg rrShN rrShT rrShY rrShy rrdhw rrghY rrghy rrjNG rrshY rrshw rrshy rrthY
    rrthy rrShNY rrShNy
""".split()
#: Conjuncts with a spelling of their own.
OWN = {
    "ক্ষ": "kkh ksh",
    "ক্ষ্ণ": "kkhN kshN",
    "ক্ষ্ব": "kkhw kshw",
    "ক্ষ্ম": "kkhm kshm",
    "ক্ষ্ম্য": "kkhmy kshmy",
    "ক্ষ্য": "kkhY kkhy kshy",
    "গ্\u200cণ": "gN",
    "ঙ্ক্ষ": "Ngksh",
    "ঙ্\u200cক্ত": "Ngkt",
    "জ্ঞ": "Jn gg jn",
    "ঞ্জ": "nJ nj",
    "র্জ্ঞ": "rrJn rrjn",
    "স্প্\u200cল": "spl",
    "ৎক": "tk",
    "ৎখ": "tkh",
    "ৎপ": "tp",
    "ৎল": "tl",
    "ৎস": "ts",
}
_SPELLING = {"y": "য", "Y": "য", "w": "ব", "rr": "র"}


def _letters(key: str) -> list[str]:
    out, i = [], 0
    while i < len(key):
        n = next(n for n in (3, 2, 1) if len(key) - i >= n and (key[i : i + n] in _SPELLING or key[i : i + n] in CONSONANTS))
        part = key[i : i + n]
        out.append(_SPELLING.get(part) or CONSONANTS[part])
        i += n
    return out


CONJUNCTS = {k: HASANT.join(_letters(k)) for k in SPELLED} | {k: v for v, keys in OWN.items() for k in keys.split()}
#: Every beginning of a conjunct key: where a longer match may still come.
CONJUNCT_HEADS = {k[:n] for k in CONJUNCTS for n in range(1, len(k) + 1)}
_CANON = {"ch": "chh C Ch CH Chh CHH", "kh": "Kh KH", "gh": "Gh GH", "j": "J", "jh": "Jh JH", "Th": "TH", "Dh": "DH", "ph": "Ph PH f", "bh": "Bh BH v", "y": "Y", "sh": "S", "Sh": "SH"}
CANONICAL = {alias: key for key, aliases in _CANON.items() for alias in aliases.split()}


def canonical(part: str) -> str:
    return CANONICAL.get(part, part)


def conjunct_of(parts) -> str | None:
    """The listed conjunct of component keys."""
    return CONJUNCTS.get("".join(map(canonical, parts))) if len(parts) > 1 else None


def components(conjunct: str) -> list[str]:
    """Component keys of a conjunct as its first key spells it, longest first; empty if it is none."""
    key = next((k for k, v in CONJUNCTS.items() if v == conjunct), "")
    out, i = [], 0
    while i < len(key):
        n = next(n for n in (3, 2, 1) if key[i : i + n] in CONSONANTS or key[i : i + n] in _SPELLING)
        out.append(key[i : i + n])
        i += n
    return out


def rule_rows() -> list[tuple[str, str, str, str | None]]:
    """(roman, kind, independent, dependent): all tables in rows."""
    rows = [(k, f"consonant:{g}", v, None) for g, t in LETTERS.items() for v, keys in t.items() for k in keys.split()]
    rows += [(k, "vowel", a, b) for k, (a, b) in VOWELS.items()] + [(k, "sign", v, None) for k, v in SIGNS.items()]
    return rows + [(k, "symbol", v, None) for k, v in SYMBOLS.items()] + [(k, "digit", v, None) for k, v in DIGITS.items()] + [(k, "conjunct", v, None) for k, v in CONJUNCTS.items()]
