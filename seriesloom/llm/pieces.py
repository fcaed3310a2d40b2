"""Splitting texts by a pattern of letters, numbers and spaces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Up to here the classes of letters, numbers and spaces are the same in any version of Unicode.
SETTLED = 0x24F


def _class(test: Callable[[str], bool]) -> str:
    """The inside of a character class, as ranges."""
    found = [i for i in range(SETTLED + 1) if test(chr(i))]
    out, first = "", None
    for i, c in enumerate(found):
        first = c if first is None else first
        if i + 1 == len(found) or found[i + 1] != c + 1:
            out += f"\\u{first:04x}-\\u{c:04x}"
            first = None
    return out


def settled_pattern(pattern: str) -> str | None:
    r"""The pattern with \p{L}, \p{N} and \s spelt out for settled letters, or None if it has other properties."""
    classes = {r"\p{L}": _class(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": _class(lambda c: unicodedata.category(c)[0] == "N"), r"\s": _class(lambda c: c in "\t\n\v\f\r\x85" or unicodedata.category(c)[0] == "Z")}
    spaces = classes[r"\s"]
    out, i, inside = "", 0, False
    while i < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, i)), None)
        if name:
            out += classes[name] if inside else f"[{classes[name]}]"
            i += len(name)
        elif pattern.startswith(r"\S", i):
            if inside:
                return None
            out += f"[^{spaces}]"
            i += 2
        elif pattern[i] == "\\":
            if pattern[i + 1] in "pPwWdDbBhvVX":
                return None
            out += pattern[i : i + 2]
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out += pattern[i]
            i += 1
    return out


class Splitter:
    """All matches of the pattern; of settled texts by the faster of two libraries, with the same result."""

    def __init__(self, pattern: str):
        import regex

        self.any = regex.compile(pattern).findall
        plain = settled_pattern(pattern)
        self.fast = re.compile(plain).findall if plain else self.any
        self.beyond = re.compile(f"[^\\u0000-\\u{SETTLED:04x}]").search

    def unsettled(self, text: str) -> bool:
        """Whether a letter of the text is not settled; texts of one-byte letters need not be searched."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.beyond(text) is not None
        return False

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.unsettled(text) else self.fast(text)
