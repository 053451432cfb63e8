"""Words of a text, compared without regard to case, accents and invisible characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _dropped() -> re.Pattern[str]:
    """Accents (combining marks) and invisible characters (format and other non-printing ones without space meaning)."""
    gone = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf") or c in (0x115F, 0x1160, 0x3164, 0xFFA0)]
    spans, start = [], gone[0]
    for a, b in zip(gone, gone[1:] + [None]):
        if b != a + 1:
            spans.append(re.escape(chr(start)) + ("-" + re.escape(chr(a)) if a > start else ""))
            start = b
    return re.compile("[" + "".join(spans) + "]+")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKD", text):
        # folding case can bring new marks, and decomposition new capitals
        text = unicodedata.normalize("NFKD", text).casefold()
    return _dropped().sub("", text)


def words(text: str | None) -> list[str]:
    return WORD.findall(folded(text)) if text else []
