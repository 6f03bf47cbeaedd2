"""Card and reading expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"

# Key codes of the keypad and the action each one records.
# 55 arrival, 57 departure, 49 break start, 51 break end; 53 asks to void the last reading.
KEY_ACTIONS = {55: 1, 57: 2, 49: 3, 51: 4}
VOID_KEY = 53

# The three known cards.
KNOWN_CARDS = [
    ("Card A", [5, 74, 28, 185, 234]),
    ("Card B", [83, 164, 247, 164, 164]),
    ("Card C", [20, 38, 121, 207, 132]),
]
WRONG_CARD = "wrong Card"
UNKNOWN_CARD = "Neznama karta"

# Cyrillic letters whose ASCII form is one letter, then those that need several or none.
_CYRILLIC_ONE = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "з": "z", "и": "i",
    "й": "i", "і": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "ы": "y", "э": "e", "ь": "'", "ъ": '"',
}
_GREEK_ONE = dict(zip("αβγδεζηικλμνξοπρσςτυω", "abgdezeiklmnxoprsstuo"))
_SEVERAL = {
    "є": "ie", "ё": "io", "ж": "zh", "ї": "yi", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ю": "iu", "я": "ia", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th",
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps",
    "€": "EUR", "£": "PS", "…": "...", "—": "--", "«": "<<", "»": ">>", "©": "(c)", "®": "(r)", "™": "tm", "№": "No.",
}
# Signs whose ASCII form is one character.
_SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "―": "-", "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "′": "'", "″": '"', "•": "*", "·": "*", "×": "x", "÷": "/", "¿": "?", "¡": "!", "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ",
    "\u202f": " ", "\u3000": " ",
}


def fold_table() -> tuple[dict[str, str], dict[str, str]]:
    """What becomes one ASCII character, and what several: by Unicode decomposition, and for what has none by the tables above."""
    one = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ı": "i", "ð": "d", "Ð": "D"}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            one[chr(code)] = plain if plain.isascii() else _GREEK_ONE.get(plain) or _GREEK_ONE.get(plain.lower(), "").upper() or chr(code)
    for letter, ascii_letter in (_CYRILLIC_ONE | _GREEK_ONE).items():
        one[letter] = ascii_letter
        if letter != "ς":
            one[letter.upper()] = ascii_letter.upper()
    one |= _SIGNS
    several = {}
    for letter, spelled in _SEVERAL.items():
        several[letter] = spelled
        if letter.upper() != letter and len(letter.upper()) == 1:
            several[letter.upper()] = spelled.capitalize()
    return {k: v for k, v in one.items() if k != v and k not in several}, several


def ascii_fold(text: Column) -> Column:
    """Text in ASCII: accents removed, Cyrillic and Greek transliterated, signs spelled. What has no ASCII form stays as it is."""
    one, several = fold_table()
    folded = F.translate(text, "".join(one), "".join(one.values()))
    for letter, spelled in several.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def tag_id(uid: Column) -> Column:
    return F.array_join(F.transform(uid, lambda b: b.cast("string")), "")


def tag_label(uid: Column) -> Column:
    return F.array_join(F.transform(uid, lambda b: b.cast("string")), ",")


def uid_checksum(uid: Column) -> Column:
    """Five bytes whose last is the exclusive or of the others."""
    mixed = F.aggregate(F.slice(uid, 1, 4), F.lit(0), lambda acc, b: acc.bitwiseXOR(b))
    return F.when(F.size(uid) == 5, mixed == F.get(uid, 4)).otherwise(F.lit(False))


def key_to_action(key: Column) -> Column:
    action = F.lit(None).cast("int")
    for code, number in KEY_ACTIONS.items():
        action = F.when(key == code, F.lit(number)).otherwise(action)
    return action


def is_void_request(key: Column) -> Column:
    return key == VOID_KEY


def second_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def stamp_seconds(stamp: Column) -> Column:
    """Seconds on the wall clock of a stamp, without going through a time zone."""
    day = F.unix_date(F.to_date(F.substring(stamp, 1, 8), "yyyyMMdd")).cast("bigint")
    return (
        day * 86400
        + F.substring(stamp, 9, 2).cast("int") * 3600
        + F.substring(stamp, 11, 2).cast("int") * 60
        + F.substring(stamp, 13, 2).cast("int")
    )


def lookback_bound(as_of: Column, minutes: int) -> Column:
    """Stamp ``minutes`` before ``as_of``; a reading counts when its stamp is greater."""
    return second_stamp(as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
