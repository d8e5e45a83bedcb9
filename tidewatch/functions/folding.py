"""ASCII transliteration tables for message folding.

The bulk table is built by a rule over all code points: Unicode NFKD with
combining marks dropped, where one ASCII character is left (accented, full
width, styled and circled letters), and the marks themselves are removed.
Letters without such a decomposition come from the fixed lists below.  The
tables drive a JVM ``translate`` (one character to one or none) plus
``replace`` calls (one character to several).  Characters outside the tables
are kept unchanged (the "preserve" behaviour).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters and punctuation with no NFKD route to ASCII, and the
# ASCII text they fold to.
SPECIAL_FOLDS = {
    "ß": "ss",
    "æ": "ae",
    "Æ": "AE",
    "œ": "oe",
    "Œ": "OE",
    "ø": "o",
    "Ø": "O",
    "đ": "d",
    "Đ": "D",
    "ð": "d",
    "Ð": "D",
    "ł": "l",
    "Ł": "L",
    "þ": "th",
    "Þ": "Th",
    "ı": "i",
    " ": " ",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "--",
    "…": "...",
    "«": "<<",
    "»": ">>",
    "¡": "!",
    "¿": "?",
}

# Transliteration of the small Cyrillic and Greek letters (a
# capital takes the same with its first letter in upper case).
LETTER_FOLDS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l",
    "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph",
    "χ": "kh", "ψ": "ps", "ω": "o",
}
# Latin ligatures, folded to their letters.
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆĳĲǆǅǄǉǈǇǌǋǊǳǲǱ"
# Blocks of combining marks that attach to any letter.
MARK_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
LAST_CODE_POINT = 0x1FFFF   # styled letters end below; beyond are ideographs


def letter_folds() -> dict[str, str]:
    """``LETTER_FOLDS`` with capitals."""
    out = dict(LETTER_FOLDS)
    for ch, rep in LETTER_FOLDS.items():
        if ch.upper() != ch and len(ch.upper()) == 1:
            out.setdefault(ch.upper(), rep.capitalize())
    return out


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Return ``(translate_from, translate_to, multi_char_replacements)``;
    the characters of the first beyond the length of the second go."""
    letters = letter_folds()
    one_to_one: dict[str, str] = {}
    multi: dict[str, str] = {}
    marks = []
    for cp in range(0x80, LAST_CODE_POINT + 1):
        ch = chr(cp)
        if any(lo <= cp <= hi for lo, hi in MARK_BLOCKS):
            marks.append(ch)
            continue
        plain = unicodedata.normalize("NFKD", ch)
        if plain == ch or ch.isspace():
            continue
        base = "".join(letters.get(c, c) for c in plain if not unicodedata.combining(c))
        if not base or not base.isascii() or base.isspace():
            continue
        if len(base) == 1:
            one_to_one[ch] = base
        elif ch in LIGATURES or (cp < 0x0530 and plain[0] in letters):
            multi[ch] = base
    for ch, rep in {**letters, **SPECIAL_FOLDS}.items():
        (one_to_one if len(rep) == 1 else multi)[ch] = rep
    src = "".join(sorted(one_to_one))
    dst = "".join(one_to_one[c] for c in src)
    return src + "".join(marks), dst, tuple(sorted(multi.items()))


@lru_cache(maxsize=1)
def python_whitespace() -> str:
    """Every character ``str.strip()`` removes (Unicode White_Space)."""
    return "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def fold_python(text: str) -> str:
    """The same folding for driver-side values (term lists)."""
    src, dst, multi = fold_tables()
    out = text.translate(str.maketrans(src[:len(dst)], dst, src[len(dst):]))
    for ch, rep in multi:
        out = out.replace(ch, rep)
    return out
