import random

import numpy as np
import pytest

from docweft.llm import near_duplicates as nd
from docweft.llm.blocks import blocks

SCHEMA = "tbl string, id bigint, content string"
rng = random.Random(4)
_checked = nd._checked


def text(n):
    return "".join(rng.choice("가나다라마바사아자차카타파하abcdefgh0123 ") for _ in range(n))


def edited(s, share):
    out = list(s)
    for _ in range(int(len(s) * share / 5)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["나", "b"], ["다"]])
    return "".join(out)


def brute(rows, threshold=0.6):
    kept = {}
    for tbl, i, c in rows:
        if i is not None and len(n := nd.normalised(c or "")) >= 60:
            kept[tbl, i] = n
    ids = sorted(kept)
    return {(x[0], x[1], y[1]) for k, x in enumerate(ids) for y in ids[k + 1 :] if x[0] == y[0] and nd.jaccard(kept[x], kept[y]) >= threshold}


def sample():
    rows = []
    for k in range(60):
        base = text(rng.choice([90, 200, 800]))
        rows.append(("a" if k % 2 else "b", 10 * k, base))
        for j in range(k % 4):
            rows.append(("a" if k % 2 else "b", 10 * k + j + 1, edited(base, 0.3 * j + 0.1)))
    rows += [("a", 9001, rows[0][2].upper() + " !"), ("b", 9002, rows[0][2] + "\n"), ("b", 9003, rows[0][2])]
    rows += [("a", 9004, None), ("a", 9005, ""), ("a", None, text(100)), ("a", 9006, "짧다"), ("b", 9003, rows[0][2]), ("a", 9007, "가" * 30000), ("a", 9008, "가" * 29000)]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = sample()
    found = nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got))
    # Of two records one at least is the first of its content.
    first = {}
    for t, i, c in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        first.setdefault((t, c), i)
    home = {(t, i): first[t, c] for t, i, c in rows if i is not None}
    assert set(got) == {(t, a, b) for t, a, b in brute(rows) if home[t, b] == a or home[t, a] != home[t, b] and (home[t, a] == a or home[t, b] == b)}
    groups = {(r.tbl, r.id): r.group_id for r in found.groups().collect()}
    assert all(groups[t, a] == groups[t, b] for t, a, b in got)
    linked = {(t, x) for t, a, b in got for x in (a, b)}
    assert all(g == i for (t, i), g in groups.items() if (t, i) not in linked)
    assert sum(len(nd.normalised(c or "")) >= 60 for _, i, c in {r[:2]: r for r in rows}.values() if i is not None) == len(groups)


@pytest.mark.parametrize("copies", [2, 3, 64, 65, 66, 300])
def test_copies_are_a_star_at_every_size(spark, copies):
    base = text(200)
    rows = [("a", i, base) for i in range(copies)] + [("a", 1000, base[:100] + "새말" + base[100:])]
    got = {(r.id_a, r.id_b) for r in nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}
    assert got == {(0, i) for i in range(1, copies)} | {(i, 1000) for i in range(copies)}


def test_groups_cost_in_proportion_to_the_records(spark, monkeypatch):
    """Records of one template: no closure, and far fewer links are tested than there are pairs."""
    monkeypatch.setattr(nd, "HOT", 16)
    base = text(600)
    for n in (100, 400):
        seen = []
        monkeypatch.setattr(nd, "_checked", lambda links, texts, f=_checked, seen=seen: seen.append(links.count()) or f(links, texts))
        found = nd.NearDuplicates(spark.createDataFrame([("a", i, edited(base, 0.08)) for i in range(n)], SCHEMA))
        monkeypatch.setattr(found, "_closed", None)
        assert {r.group_id for r in found.groups().collect()} == {0}
        assert sum(seen) < nd.BANDS * n


def test_leaves_unlike_their_centre_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 4)
    letter = text(600).replace(" ", "")[:400]
    rows = [("a", 0, letter + text(200).replace(" ", "")[:150])]
    for i in range(12):
        own, same = (text(400).replace(" ", "")[:250] for _ in range(2))
        rows += [("a", 100 + i, letter + same[:60] + own[20:110]), ("a", 200 + i, letter + same[:60] + own[110:200])]
    groups = {r.id: r.group_id for r in nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA), bands=64, rows=1).groups().collect()}
    assert all(groups[a] == groups[b] for _, a, b in brute(rows))
    assert len(set(groups.values())) == 13


def test_contents_of_a_large_class_that_differ_keep_their_links(spark):
    base = text(200).replace(" ", "")
    rows = [("a", i, base[:100] + " " * i + base[100:]) for i in range(70)] + [("a", 70 + i, base + "!") for i in range(70)] + [("a", 1000, base[:100] + "새말" + base[100:])]
    got = {(r.id_a, r.id_b) for r in nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}
    one = [*range(70), 70, 1000]
    copies = range(71, 140)
    assert got == {(x, y) for x in one for y in one if x < y} | {(min(x, y), max(x, y)) for x in one for y in copies}


def test_a_chain_is_one_group(spark):
    pieces = [text(120) for _ in range(14)]
    rows = [("a", 50 - i, " ".join(pieces[i : i + 5])) for i in range(10)]
    found = nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(t, a, b) for t, a, b in (tuple(r) for r in found.pairs().collect())} == brute(rows)
    assert {r.group_id for r in found.groups().collect()} == {41}


def test_empty_table(spark):
    found = nd.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert found.pairs().collect() == []
    assert found.groups().collect() == []


def test_signatures_estimate_similarity():
    a = text(2000)
    b = edited(a, 0.5)
    x, y = nd.signatures([a, b], 1024)
    assert abs(np.mean(x == y) - nd.jaccard(nd.normalised(a), nd.normalised(b))) < 0.12
    alone, among = nd.signatures([a[:60]], 128)[0], nd.signatures([b, a[:60], a], 128)[1]
    assert (alone == among).all()


def test_blocks_change_no_signature(monkeypatch):
    texts = [text(n).replace(" ", "") for n in (70, 900, 5000, 80)]
    whole = nd.signatures(texts, 128)
    monkeypatch.setattr(nd, "blocks", lambda t, overlap: blocks(t, 300, overlap))
    assert (nd.signatures(texts, 128) == whole).all()


@pytest.mark.parametrize("hot", [4, 10**6])
def test_pairs_of_a_bucket_whose_centre_is_unlike_both(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT", hot)
    letter = text(600).replace(" ", "")[:400]
    rows = [("a", 0, letter + text(200).replace(" ", "")[:150])]
    # The letter alone is a similarity just under the threshold; what a pair shares besides is in an earlier, unlike row too.
    for i in range(20):
        own, same = (text(400).replace(" ", "")[:250] for _ in range(2))
        rows.append(("a", 10 + i, same[:60] + own[:20]))
        rows += [("a", 100 + i, letter + same[:60] + own[20:110]), ("a", 200 + i, letter + same[:60] + own[110:200])]
    want = brute(rows)
    assert len(want) == 20
    assert 0.5 < nd.jaccard(rows[0][2], rows[2][2]) < 0.6
    found = nd.NearDuplicates(spark.createDataFrame(rows, SCHEMA), bands=64, rows=1)
    assert {tuple(r) for r in found.pairs().collect()} == want


def test_rarest_shingles_of_similar_texts_meet(spark):
    base = text(500)
    rows = [("a", i, nd.normalised(edited(base, 0.1 * (i % 6))[: 420 + 9 * i])) for i in range(40)]
    norms = spark.createDataFrame([(t, i, True, n) for t, i, n in rows], "tbl string, id bigint, failed boolean, norm string")
    links = nd._sharing(nd._prefixed(norms, 0.6, nd._common(norms, 40)), 0.6)
    assert {tuple(r) for r in links.collect()} >= brute(rows)


def test_bands_catch_most_pairs_at_the_threshold():
    assert 1 - (1 - 0.65**nd.ROWS) ** nd.BANDS > 0.99


def _by_bucket(spark, digests):
    rows = [("a", i, d, [b]) for i, (b, d) in enumerate(digests)]
    return [tuple(r) for r in nd._linked(spark.createDataFrame(rows, "tbl string, id bigint, digest binary, bands array<bigint>"), 0.6).collect()]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_a_bucket_shared_by_chance_gives_its_close_pairs_alone(spark, monkeypatch, block):
    """No row for each pair of a small bucket, and no star with failed leaves in a large one."""
    monkeypatch.setattr(nd, "BLOCK", block)
    digest = lambda: bytes(rng.randrange(256) for _ in range(32))
    several = {1: 2, 2: 100, 3: 128, 4: 129, 5: 700, 6: 1}
    digests = [(b, digest()) for b, n in several.items() for _ in range(n)]
    for i, j in ((0, 1), (5, 90), (110, 200), (240, 350), (400, 900), (401, 1000)):
        digests[j] = (digests[j][0], digests[i][1][:28] + digests[j][1][28:])
    rng.shuffle(digests)
    same = lambda x, y: sum((p >> 4 == q >> 4) + (p & 15 == q & 15) for p, q in zip(x, y, strict=True))
    want = {(b, i, j) for i, (b, x) in enumerate(digests) for j, (c, y) in enumerate(digests) if i < j and b == c and same(x, y) >= nd._least(0.6)}
    got = _by_bucket(spark, digests)
    assert len(want) >= 5
    assert {(b, x, y) for _, b, x, y, near, leaf in got if near and not leaf} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("wide", [150, 4096])
@pytest.mark.parametrize("block", [7, 1 << 16])
def test_a_large_bucket_of_the_like_is_a_star(spark, monkeypatch, block, wide):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "WIDE", wide)
    digests = [(1, bytes(32))] * 400 + [(1, bytes([255] * 32))] * 2 + [(2, bytes(32))] * 3
    got = _by_bucket(spark, digests)
    assert {(x, y, near) for _, b, x, y, near, leaf in got if leaf} == {(0, i, i < 400) for i in range(1, 402)}
    assert {(x, y) for _, b, x, y, near, leaf in got if not leaf} == {(402, 403), (402, 404), (403, 404)}
    assert len(got) == 404
