"""Text functions on Python strings, for queries and settings given as literals on the driver."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from docweft.functions.text import PARTICLES, SEARCH_STOPWORDS


def normalize(text: str | None) -> str:
    merged = re.sub(r"a\s*[/.\-]?\s*s|에이에스", "as", (text or "").lower())
    return " ".join(re.sub(r"[^0-9a-z가-힣]+", " ", merged).split())


def compact(text: str | None) -> str:
    return normalize(text).replace(" ", "")


def words(text: str | None) -> list[str]:
    return normalize(text).split()


def bm25_tokens(text: str | None) -> list[str]:
    return [w for w in words(text) if len(w) >= 2 or w.isdigit()]


def ngram_set(text: str | None) -> set[str]:
    dense = compact(text)
    hangul = re.sub("[0-9a-z]+", "", dense)
    return {w for w in re.findall("[0-9a-z]{2,}", normalize(text))} | {s[i : i + n] for s in (dense, hangul) for n in (2, 3) for i in range(len(s) - n + 1)}


def without_particle(term: str) -> str:
    return next((term[: -len(p)] for p in PARTICLES if term.endswith(p) and len(term) > len(p) + 1), term)


def search_terms(query: str) -> list[str]:
    found = map(without_particle, words(query))
    return list(dict.fromkeys(t for t in found if (len(t) >= 2 or t.isdigit()) and t not in SEARCH_STOPWORDS))


def expansion(query: str, synonyms: dict[str, list[str]]) -> list[str]:
    own = words(query)
    found = (normalize(s) for w in own for s in synonyms.get(w, ()))
    return list(dict.fromkeys(s for s in found if s and s not in own))


@lru_cache(1 << 17)
def _bucket(token: str) -> tuple[int, float]:
    """Hash of a token and its sign."""
    digest = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big"), 1.0 if digest[4] % 2 == 0 else -1.0


def hash_vector(text: str | None, dim: int) -> list[float]:
    """Signed feature hashing of tokens and n-grams to a unit vector; zeros for a text without any."""
    out = [0.0] * dim
    for token in bm25_tokens(text) + sorted(ngram_set(text)):
        place, sign = _bucket(token)
        out[place % dim] += sign
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out
