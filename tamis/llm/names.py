"""Text forms that the matching operators share."""

from __future__ import annotations

import re
import unicodedata

#: Digits that stand for letters in misread words.
MISREAD = str.maketrans({"0": "o", "1": "i", "5": "s", "6": "g", "8": "b", "2": "z"})
_FOLDED = str.maketrans({"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility form, without combining marks and with the common ligatures resolved."""
    out = unicodedata.normalize("NFKD", text).lower().translate(_FOLDED)
    return out if out.isascii() else "".join(c for c in out if not unicodedata.combining(c))


def letters(token: str) -> str:
    """The token with misread digits as letters, where it has letters at all."""
    return token.translate(MISREAD) if not token.isalpha() and not token.isdigit() else token


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(fold(text))


def osa(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; most + 1 where there are more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)
