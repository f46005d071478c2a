"""Words of a byte-level pre-tokenizer.

The pattern's Unicode classes are written out as ranges of the basic plane for the standard library's engine, which is
about twice as fast as one that knows the classes. Texts with characters beyond the plane go to the latter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=None)
def _ranges(kind: str) -> str:
    """The characters of a class in the basic plane, as the inside of a bracket."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = regex.finditer(f"{kind}+", plane)
    out = []
    for run in runs:
        first = last = ord(run[0][0])
        for c in map(ord, run[0][1:]):
            if c != last + 1:
                out.append((first, last))
                first = c
            last = c
        out.append((first, last))
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def written_out(pattern: str) -> str:
    """The pattern with ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S`` as explicit ranges."""
    parts = re.split(r"(\[[^\]]*\])", pattern)  # brackets stand at the odd places
    for n, part in enumerate(parts):
        for kind in _CLASSES:
            part = part.replace(kind, _ranges(kind) if n % 2 else f"[{_ranges(kind)}]")
        parts[n] = part.replace(r"\S", f"[^{_ranges(_CLASSES[2])}]")
    return "".join(parts)


def word_finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern."""
    usual, every = re.compile(written_out(pattern)).findall, regex.compile(pattern).findall

    def words(text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return usual(text)
        return every(text)

    return words
