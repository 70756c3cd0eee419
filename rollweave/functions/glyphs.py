"""Legacy-glyph names to Devanagari to Latin.

One regular expression cuts a glyph text into tokens: a prefix mark, a consonant glyph and
its tail, or a vowel, or a single sign. The tokens form a small closed vocabulary, so each
is spelled once per task and then looked up; this runs as an Arrow UDF over the distinct
values of a batch, because Spark has no replace-by-lookup and a composition of array
functions was measured at about a fortieth of the speed. Latin is made from Devanagari by
built-in expressions.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from rollweave.functions.text import squeeze

# The spelling helper travels inside the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------
# The glyph font's code table and the romanisation table.
# ---------------------------------------------------------------------------

CONSONANTS_2 = {
    "Eò": "क", "Gò": "क्र", "Hò": "क्त", "Uô": "छ", "`ö": "ठ", "b÷": "ड", "fø": "ढ", "nù": "द",
    "pù": "द्र", "qù": "द्द", "¡ò": "फ", "®ú": "र", "¯û": "रु", "°ü": "रू", "³ý": "ळ", "½þ": "ह",
    "]õ": "ट", "®ô": "र", "Âö": "्ठ", "Âõ": "्ट", "Âù": "्द", "Â÷": "्ड",
}
CONSONANTS_1 = {
    "C": "क्", "E": "क", "F": "क़", "G": "क्र", "H": "क्त", "I": "क्ष", "J": "ख", "K": "ख़",
    "L": "ख्र", "M": "ग", "N": "ग़", "O": "ग्र", "P": "घ", "Q": "घ्र", "R": "ङ", "S": "च",
    "T": "च्र", "U": "छ", "V": "ज", "W": "ज़", "X": "ज्र", "Y": "ज्ञ", "Z": "झ", "[": "झ्र",
    "\\": "ञ", "]": "ट", "^": "ट्ट", "_": "ट्ठ", "`": "ठ", "a": "ठ्ठ", "b": "ड", "c": "ड़",
    "d": "ड्ड", "e": "ड्ढ", "f": "ढ", "g": "ढ़", "h": "ण", "i": "त", "j": "त्र", "k": "त्त",
    "l": "थ", "m": "थ्र", "n": "द", "o": "दृ", "p": "द्र", "q": "द्द", "r": "द्ध", "s": "द्म",
    "t": "द्य", "u": "द्व", "v": "ध", "w": "ध्र", "x": "न", "y": "न्र", "z": "न्न", "{": "प",
    "|": "प्र", "}": "फ्", "~": "फ़्", "¡": "फ", "¢": "फ़", "£": "फ्र", "¤": "ब", "¥": "ब्र",
    "¦": "भ", "§": "भ्र", "¨": "म", "©": "म्र", "ª": "य", "«": "य्र", "®": "र", "¯": "रु",
    "°": "रू", "±": "ल", "²": "ळ्", "³": "ळ", "´": "व", "µ": "व्र", "¶": "श", "•": "श्व",
    "·": "श्व", "¸": "श्र", "¹": "ष", "º": "स", "»": "स्र", "¼": "ह्", "½": "ह", "À": "ह्म",
    "Á": "ह्य", "¾": "हृ", "¿": "ह्र",
}
MATRAS = {
    "Ò": "ी", "Ó": "ी", "Ö": "ु", "×": "ु", "Ù": "ु", "Ú": "ू", "Ý": "ू", "Þ": "ृ", "ß": "ॄ",
    "ä": "े", "æ": "े", "è": "ै",
}
COMPOSITES = {"å": "ें", "é": "ैं", "ì": "ॅ"}
MODIFIERS = {"Æ": "ं", "È": "ं", "Ä": "ँ", "Â": "्", "Ã": "़", "Å": "्र"}
VOWELS = {"+": "अ", "<": "इ", "=": "उ", ">": "ऊ", "@": "ऋ", "A": "ॠ", "B": "ए", "‹": "ए"}
SPECIALS = {"¬": "्य", "Ï": "च्छि", "Î": "स्थि", "$": "ॐ", "&": "ः", "*": "।"}
IGNORED = "ðñŸã†"
HINTS = "òóôõö÷øùúûüýþ"
CARRIER = "É"
REPHA_MARKS = "ÇÌ"
REPHA_II = "Ô"

ROMAN = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ॠ": "ri",
    "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o",
    "ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "ॄ": "ri", "े": "e",
    "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ॅ": "e",
    "ं": "n", "ँ": "n", "ः": "h",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j",
    "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t",
    "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh",
    "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v", "श": "sh", "ष": "sh",
    "स": "s", "ह": "h", "्": "", "़": "", "।": ".", "ॐ": "om",
}
# The one conjunct whose Latin form is not the sum of its letters.
GNYA = ("ज्ञ", "gny")
DEV_LETTERS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह़"
DEV_SIGNS = "ंँः़"

# ------------------------- end of fixed values ------------------------------

HALANT, AA, II, I_SIGN, REPHA = "्", "ा", "ी", "ि", "र्"


def _one_of(table) -> str:
    """Alternation of keys, longest first; a class when all are single characters."""
    keys = sorted(table, key=len, reverse=True)
    return "(?:" + "|".join(map(re.escape, keys)) + ")"


def _grammar() -> re.Pattern:
    m, x, d, h, r = (_one_of(t) for t in (MATRAS, COMPOSITES, MODIFIERS, HINTS, REPHA_MARKS))
    after = f"Ô|{m}{h}*|{x}{h}*"
    wide_tail = f"É(?:Ô|(?={r})|{m}|{x}|{d}*)|{after}|{d}*"
    narrow_tail = f"É(?:Ô|(?={r})|É{m}?|{m}|{x}|{d}*)|{after}|{r}{h}*|"
    syllable = (
        f"(?:(?P<wide>{_one_of(CONSONANTS_2)})(?P<wtail>{wide_tail})"
        f"|(?P<narrow>{_one_of(CONSONANTS_1)})(?P<ntail>{narrow_tail}))"
    )
    plain = re.sub(r"\(\?P<\w+>", "(?:", syllable)
    return re.compile(
        f"(?P<pre>{r}{h}*(?={plain})|[ÊË](?={plain}))?{syllable}|(?P<mark>{r}{h}*|[ÊË])"
        f"|\\+(?P<abody>(?:É(?:É{m}?|{m})?)?)(?P<amods>{d}*)|(?P<vowel><[ÇÈ]?É?|BÉ?ä?|[=>@A‹]É?)|(?P<sign>.)",
        re.DOTALL,
    )


TOKEN = _grammar()
_SIGNS = str.maketrans({**MATRAS, **COMPOSITES, **MODIFIERS, **dict.fromkeys(CARRIER + HINTS, "")})
_SINGLES = {**SPECIALS, **MODIFIERS, **COMPOSITES, **dict.fromkeys(CARRIER + HINTS + IGNORED, "")}
_MARKED = {"Ê": I_SIGN, "Ë": II}
_WHOLE_VOWELS = {"<Ç": "ई", "<È": "ईं"}


def _with_long_a(rest: str) -> str:
    """aa followed by e or ai is one sign: o or au."""
    return {"े": "ो", "ै": "ौ"}.get(rest, AA + rest)


def _syllable(cons: str, tail: str, wide: bool, stopped: bool) -> str:
    rest = tail.translate(_SIGNS)
    if REPHA_II in tail:
        return REPHA + cons + II
    if tail[:1] and tail[0] in REPHA_MARKS:
        return REPHA + cons
    if wide:
        # One carrier already lengthens a wide glyph, unless a repha mark comes next.
        return cons + (rest if tail[:1] != CARRIER or stopped else _with_long_a(rest))
    if tail.startswith(CARRIER * 2):
        return cons + _with_long_a(rest)
    # A narrow glyph without any tail is joined to the next one.
    return cons + (HALANT if not tail and not cons.endswith(HALANT) else rest)


def _spell(m: re.Match, text: str) -> str:
    if m["sign"] is not None:
        return _SINGLES.get(m["sign"], m["sign"])
    if m["vowel"] is not None:
        v = m["vowel"]
        return _WHOLE_VOWELS.get(v[:2]) or ("ऐ" if v[0] == "B" and v.endswith("ä") else VOWELS[v[0]])
    if m["abody"] is not None:
        body, sign = m["abody"], m["abody"].translate(_SIGNS)
        base = {"े": "ओ", "ै": "औ"}.get(sign, "आ" + sign) if body else "अ"
        return base + m["amods"].translate(_SIGNS)
    if m["mark"] is not None:
        return _MARKED.get(m["mark"], REPHA)
    wide = m["wide"] is not None
    cons, tail = (CONSONANTS_2[m["wide"]], m["wtail"]) if wide else (CONSONANTS_1[m["narrow"]], m["ntail"])
    stopped = tail == CARRIER and text[m.end():m.end() + 1] in tuple(REPHA_MARKS)
    syllable = _syllable(cons, tail, wide, stopped)
    if not m["pre"]:
        return syllable
    return syllable + _MARKED[m["pre"]] if m["pre"] in _MARKED else REPHA + syllable


# Words kept per task before the memo starts afresh.
MEMO_WORDS = 500_000


def spell_glyphs(text: str, memo: dict | None = None) -> str:
    """Devanagari of one glyph text. A blank ends a syllable, so words are independent."""
    memo = {} if memo is None else memo
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = text.split(" ")
    for w in words:
        if w not in memo:
            memo[w] = TOKEN.sub(lambda m, w=w: _spell(m, w), w)
    return " ".join([memo[w] for w in words])


def to_devanagari(c: Column) -> Column:
    """Legacy-glyph text to Unicode Devanagari."""
    memo: dict = {}

    def convert(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else spell_glyphs(n, memo))

    return F.pandas_udf(convert, "string")(c)


def _cls(chars: str) -> str:
    return "[" + chars + "]"


def to_latin(dev: Column) -> Column:
    """Devanagari to Latin, an inherent *a* after every bare consonant."""
    letters, signs = _cls(DEV_LETTERS), _cls(DEV_SIGNS)
    out = F.regexp_replace(dev, f"(?<={letters})(?=\\z| |{letters}|{signs})", "a")
    out = F.replace(out, F.lit(GNYA[0]), F.lit(GNYA[1]))
    short = {k: v for k, v in ROMAN.items() if len(v) == 1}
    gone = "".join(k for k, v in ROMAN.items() if not v)
    out = F.translate(out, "".join(short) + gone, "".join(short.values()))
    for letter, latin in ROMAN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def devanagari_to_latin(dev: Column) -> Column:
    """Latin name with white space squeezed."""
    return squeeze(to_latin(dev))


def glyphs_to_latin(c: Column) -> Column:
    return devanagari_to_latin(to_devanagari(c))
