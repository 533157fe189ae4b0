"""Letter tables of the Vietnamese alphabet, built from a rule, and the folds made of them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aăâeêioôơuưy"
_TONES = ["", "̀", "̉", "̃", "́", "̣"]


def vietnamese_letters() -> str:
    """Composed Vietnamese letters beyond ASCII, lower then upper case."""
    low = [unicodedata.normalize("NFC", v + t) for v in _VOWELS for t in _TONES] + ["đ"]
    low = [c for c in low if len(c) == 1 and ord(c) > 127]
    return "".join(low + [c.upper() for c in low])


def _latin() -> str:
    """Vietnamese and other accented Latin letters of the two Latin-1/Extended-A blocks."""
    more = [chr(c) for c in range(0xC0, 0x180) if unicodedata.category(chr(c)).startswith("L")]
    return "".join(dict.fromkeys(vietnamese_letters() + "".join(more)))


def base_letter(c: str) -> str:
    """The letter under the accents; đ counts as d."""
    if c in "đðĐÐ":
        return "d" if c in "đð" else "D"
    return unicodedata.normalize("NFD", c)[0]


def accent_pairs() -> tuple[str, str]:
    """Two aligned strings for ``translate``: accented letters and their bases."""
    src = [c for c in _latin() if len(base_letter(c)) == 1 and base_letter(c).isascii()]
    return "".join(src), "".join(base_letter(c) for c in src)


ACCENTED, BARE = accent_pairs()


def strip_accents(c: Column) -> Column:
    """Accents off, native: composed letters by ``translate``, loose marks by a regex."""
    return F.regexp_replace(F.translate(c, ACCENTED, BARE), r"\p{M}+", "")
