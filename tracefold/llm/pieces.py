"""Very long texts in pieces: what works on a text a part at a time holds no more than a part."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Bytes of a piece, and of the pieces that are worked on at once.
PIECE = 1_000_000
BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def cut(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """`raw` in pieces of at most `size` bytes, each but the first beginning with a blank; a longer run without one is cut at `size`."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(b, at + 1, at + size) for b in BLANKS)
        end = end if end > at else at + size
        yield raw[at:end]
        at = end
    yield raw[at:]


def in_groups(texts: Iterable[tuple[int, str | None]], size: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """The pieces of the texts in groups of about `size` bytes: (number of the text, piece). A null text is empty."""
    owners, parts, n = [], [], 0
    for i, text in texts:
        for piece in cut((text or "").encode("utf-8", "surrogatepass"), size):
            if parts and n + len(piece) > size:
                yield owners, parts
                owners, parts, n = [], [], 0
            owners.append(i)
            parts.append(piece)
            n += len(piece)
    if parts:
        yield owners, parts
