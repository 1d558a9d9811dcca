"""Near-duplicates by sets, not ids: repeated ids, families whose base is no star's centre, and large components."""

import random

import pytest

from tallywright.llm import neardup
from test_operators import WORD, brute_components, lower


def rows_components(rows, percent=85):
    """Component ids row by row: rows are nodes, so one id may stand in several components."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall(lower(t))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = brute_components(sets, percent)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    return [(i, len(sets[k]), least[root[k]], least[root[k]] == i) for k, (i, _) in enumerate(rows)]


def got(spark, rows, percent=85):
    return sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect())


def varied(base, edits, rng):
    w = list(base)
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("turn", [False, True])
def test_one_id_with_two_texts(spark, turn):
    rng = random.Random(2)
    a, b = ([f"{x}{k}" for k in range(200)] for x in "ab")
    rows = [(1, " ".join(a)), (2, varied(a, 2, rng)), (2, varied(b, 2, rng)), (3, " ".join(b)), (4, " ".join(a)), (2, "")]
    rows = rows[::-1] if turn else rows
    assert got(spark, rows) == sorted(rows_components(rows))


def test_families_round_a_base_that_is_no_centre(spark, monkeypatch):
    """Copies at 0.86 of their base and below the threshold of each other: only the base links them, whatever its id."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(4)
    rows = []
    for f in range(4):
        base = [f"f{f}w{k}" for k in range(210)]
        rows += [(1000 * f + k, varied(base, 3, rng)) for k in range(30)] + [(1000 * f + 500, " ".join(base))]
    assert got(spark, rows) == sorted(rows_components(rows))


def test_chains_and_large_components_by_blocks(spark, monkeypatch):
    """Without hub rounds everything is left to blocks, of single components and of mixed ones."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "HUBS", 0)
    rng = random.Random(6)
    rows, words = [], [f"w{k}" for k in range(160)]
    for k in range(60):  # each differs a little from the one before
        words[rng.randrange(160)] = f"n{k}"
        rows.append((rng.randrange(40), " ".join(words)))
    rows += [(100 + k, varied(words, 1, rng)) for k in range(20)]
    assert got(spark, rows) == sorted(rows_components(rows))


def test_sets_whose_names_meet_are_named_anew(spark, monkeypatch):
    """With names of 3 bits nearly all sets share theirs: no set is lost, and none is linked for its name."""
    monkeypatch.setattr(neardup, "NAME_BITS", 3)
    rng = random.Random(8)
    rows = []
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(180)]
        rows += [(100 * f + k, varied(base, 2, rng)) for k in range(4)] + [(100 * f + 50 + k, " ".join(base)) for k in range(2)]
    rows += [(5000 + k, f"short text {k % 9}") for k in range(20)] + [(6000 + k, f"one of some more words number {k}") for k in range(20)]
    assert got(spark, rows) == sorted(rows_components(rows))


def test_found_components_are_merged_without_their_links(spark, monkeypatch):
    """Later rounds go through components alone, and edges grow with the group, not with its square."""
    given, found = [], neardup.components

    def counted(edges):
        given.append(edges.count())
        return found(edges)

    monkeypatch.setattr(neardup, "components", counted)
    totals = []
    for n in (60, 120):
        rng = random.Random(5)
        base = [f"w{k}" for k in range(200)]
        rows = [(k, varied(base, 2, rng)) for k in range(n)] + [(n, " ".join(base))]
        given.clear()
        assert got(spark, rows) == sorted(rows_components(rows))
        assert len(given) > 1 and max(given[1:]) < given[0]
        totals.append(sum(given))
    assert totals[1] < 3 * totals[0]
