"""Pieces of DuckDB SQL for the text functions that queries are checked with."""

from __future__ import annotations

from docweft.functions import text as tx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalized(e: str) -> str:
    merged = rf"regexp_replace(lower(coalesce({e}, '')), 'a(?:\s|\p{{Z}})*[/.\-]?(?:\s|\p{{Z}})*s|에이에스', 'as', 'g')"
    return f"trim(regexp_replace({merged}, '[^0-9a-z가-힣]+', ' ', 'g'))"


def compact(e: str) -> str:
    return f"replace({normalized(e)}, ' ', '')"


def words(e: str) -> str:
    return f"list_filter(string_split({normalized(e)}, ' '), lambda w: w <> '')"


def bm25_tokens(e: str) -> str:
    return f"list_filter(string_split({normalized(e)}, ' '), lambda w: length(w) >= 2 or regexp_full_match(w, '[0-9]+'))"


def any_of(e: str, found: tuple[str, ...]) -> str:
    return "(" + (" or ".join(f"contains({e}, {lit(w)})" for w in found) or "false") + ")"


def first_of(e: str, kinds: dict[str, tuple[str, ...]], default: str) -> str:
    return "case " + " ".join(f"when {any_of(e, w)} then {lit(n)}" for n, w in kinds.items()) + f" else {lit(default)} end"


def without_particle(e: str) -> str:
    return "case " + " ".join(f"when suffix({e}, {lit(p)}) and length({e}) > {len(p) + 1} then left({e}, length({e}) - {len(p)})" for p in tx.PARTICLES) + f" else {e} end"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^(?:\s|\p{{Z}})+|(?:\s|\p{{Z}})+$', '', 'g')"


def grams(e: str, n: int) -> str:
    return f"[substring({e}, i, {n}) for i in range(1, greatest(length({e}) - {n - 1}, 0) + 1)]"


def ngram_sets(e: str, rows: str = "chunks") -> str:
    """Subquery of (chunk_id, own): the n-gram set of each row; forms are materialised, as they are used often."""
    return f"""(with f as materialized (select chunk_id, {normalized(e)} as form from {rows}),
d as materialized (select chunk_id, form, replace(form, ' ', '') as dense from f), h as materialized (select *, regexp_replace(dense, '[0-9a-z]+', '', 'g') as hangul from d)
select chunk_id, list_distinct(regexp_extract_all(form, '[0-9a-z]{{2,}}') || {grams("hangul", 2)} || {grams("hangul", 3)} || {grams("dense", 2)} || {grams("dense", 3)}) as own from h)"""


#: One row per document that is not deleted.
LIVE = "live as (select distinct on (source) * from maintenance_docs where deleted_at is null order by source, doc_pk)"
SEARCHED = "concat_ws(chr(10), coalesce(title, ''), coalesce(heading, ''), coalesce(filename, ''), coalesce(folder, ''), coalesce(source, ''), coalesce(body, ''))"
