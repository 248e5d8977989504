"""Words of a text as bytes, in pieces of bounded size.

``bytes.lower`` changes A-Z only, and ``bytes.split`` without arguments cuts at
space and at 0x09-0x0D only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` cut at white space into pieces of about ``size`` bytes."""
    start = 0
    while start < len(data):
        found = _SPACE.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def word_lists(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words, piece by piece; a null text has none."""
    for piece in pieces((text or "").encode().lower(), size):
        if found := piece.split():
            yield found


# Bytes of a plain word after A-Z became a-z: 0-9, a-z, and all of non-ASCII characters.
_BREAK = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return data.lower().translate(_BREAK).split()
