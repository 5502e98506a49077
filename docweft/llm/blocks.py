"""Texts of a batch in blocks of bounded size, so that work on arrays of characters needs bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters of a block.
BLOCK_CHARS = 1 << 20


def blocks(texts: list[str], most: int = BLOCK_CHARS, overlap: int = 0) -> Iterator[tuple[list[int], list[str]]]:
    """(places in `texts`, parts): parts of together at most `most` characters, without empty ones.

    A longer text comes in several parts, each beginning with the last `overlap` characters of the one before.
    """
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + most] if len(text) > most else text
            if size and size + len(part) > most:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
            if at + most >= len(text):
                break
            at += most - overlap
    if parts:
        yield owners, parts
