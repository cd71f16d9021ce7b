"""Latin spellings of letters of other scripts, longest match first, in one pass over a text."""

from __future__ import annotations

import functools
import re
import unicodedata

# ---- Fixed values: letters and their Latin spelling, in the order of their alphabets ("-": none).
LATIN = "ß ss æ ae œ oe ø o ł l đ d ð d þ th ı i ħ h ŋ ng ə a ĸ k ŧ t"
CYRILLIC = (
    "а a б b в v г g ґ g д d ђ dj е e ё io є ie ж zh з z ѕ dz и i і i ї i й i ј j к k ќ kj л l љ lj м m н n њ nj о o п p р r с s т t ћ c у u ў u ф f х kh ц ts ч ch џ dzh ш sh щ shch ъ - ы y ь - э e ю iu я ia"
)
GREEK = "αι ai ει ei οι oi υι yi αυ au ευ eu ου ou γγ ng γξ nx γχ nch μπ b ντ nt α a β v γ g δ d ε e ζ z η i θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ y φ f χ ch ψ ps ω o"
GEORGIAN = "ა a ბ b გ g დ d ე e ვ v ზ z თ t ი i კ k ლ l მ m ნ n ო o პ p ჟ zh რ r ს s ტ t უ u ფ p ქ k ღ gh ყ q შ sh ჩ ch ც ts ძ dz წ ts ჭ ch ხ kh ჯ j ჰ h"
#: Hangul by its parts: beginnings, vowels and ends of a syllable, as Unicode numbers them.
HANGUL_BEGIN = "g kk n d tt r m b pp s ss - j jj ch k t p h"
HANGUL_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu ui i"
HANGUL_END = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h"
# ---- end of fixed values
HANGUL_FIRST, HANGUL_LAST = "가", "힣"


@functools.cache
def table() -> dict[str, str]:
    """Every spelling; letters of several code points are there as a whole."""
    pairs = " ".join((LATIN, CYRILLIC, GREEK, GEORGIAN)).split()
    return {a: "" if b == "-" else b for a, b in zip(pairs[::2], pairs[1::2])}


@functools.cache
def _pattern() -> re.Pattern[str]:
    longest_first = sorted(table(), key=lambda k: (-len(k), k))
    return re.compile("|".join(map(re.escape, longest_first)) + f"|[{HANGUL_FIRST}-{HANGUL_LAST}]")


@functools.cache
def _hangul() -> tuple[list[str], list[str], list[str]]:
    return tuple([x.replace("-", "") for x in part.split()] for part in (HANGUL_BEGIN, HANGUL_VOWEL, HANGUL_END))


def _spelt(found: re.Match[str]) -> str:
    text = found.group()
    if text in table():
        return table()[text]
    begin, vowel, end = _hangul()
    n = ord(text) - ord(HANGUL_FIRST)
    return begin[n // (len(vowel) * len(end))] + vowel[n // len(end) % len(vowel)] + end[n % len(end)]


def latin(text: str) -> str:
    """Lower case, in ASCII: marks go, letters of the scripts above are spelt out, others and CJK characters are left out."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    # what decomposes only for compatibility (ligatures, wide forms) after that
    spelt = _pattern().sub(_spelt, unicodedata.normalize("NFC", bare))
    return "".join(c for c in unicodedata.normalize("NFKD", spelt) if not unicodedata.combining(c)).encode("ascii", "ignore").decode("ascii")
