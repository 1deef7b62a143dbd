"""Moves against a file system in a dictionary: made in order nothing is lost, and nothing that could be made is refused."""

import random

import pytest

from lodestone.operators.moves import ordered_moves


def decided(spark, tmp_path, moves, files):
    df = spark.createDataFrame([*moves.items(), (None, "x"), ("y", None), ("z", "z")], "path string, target string")
    there = spark.createDataFrame([(f,) for f in [*files, *files[:1]]], "path string")
    return {r.path: r for r in ordered_moves(df, there, str(tmp_path)).collect()}


def made(rows, files):
    """Files after the moves, turn by turn; a target that is there fails."""
    at = {f: f for f in files}
    for r in rows.values():
        if r.aside:
            assert r.aside not in at
            at[r.aside] = at.pop(r.path)
    for r in sorted((r for r in rows.values() if r.made), key=lambda r: r.turn):
        assert r.target not in at, r
        at[r.target] = at.pop(r.aside or r.path)
    return at


def test_swap_chain_and_two_to_one(spark, tmp_path):
    moves = {"a": "b", "b": "a", "c": "d", "d": "e", "f": "g", "h": "g", "i": "j", "k": "i", "l": "m", "m": "n", "n": "l", "o": "h"}
    rows = decided(spark, tmp_path, moves, sorted({*moves, "j"}))
    assert {p: r.reason for p, r in rows.items()} == {**dict.fromkeys("abcdflmn"), "h": "claimed", "i": "taken", "k": "blocked", "o": "taken"}
    assert (rows["d"].turn, rows["c"].turn) == (0, 1) and {p for p, r in rows.items() if r.aside} == {"a", "l"}
    after = made(rows, sorted({*moves, "j"}))
    assert {after[t]: t for t in after}["a"] == "b" and len(after) == len({*moves, "j"})


@pytest.mark.parametrize("seed", range(3))
def test_by_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = [f"f{i:03d}" for i in range(60)]
    moves = {f: rng.choice([*files, *(f"n{i}" for i in range(25))]) for f in rng.sample(files, 45)}
    chain = [f"c{i:03d}" for i in range(40)]
    moves |= dict(zip(chain, chain[1:]))  # a long one, whose end is free
    files += chain[:-1]
    rows = decided(spark, tmp_path, moves, files)
    moves = {p: t for p, t in moves.items() if p != t}
    assert set(rows) == set(moves)
    after = made(rows, files)
    assert sorted(after.values()) == sorted(files)
    least = {}
    for p, t in sorted(moves.items()):
        least.setdefault(t, p)
    for p, r in rows.items():
        if r.reason == "claimed":
            assert least[moves[p]] != p
        elif not r.made:  # some file that stays is in the way, at the end of what it waits for
            x, seen = p, set()
            while x in moves and least[moves[x]] == x and x not in seen:
                seen.add(x)
                x = moves[x]
            assert x in files and x not in seen
        else:
            assert r.target == moves[p]


def test_no_moves(spark, tmp_path):
    assert decided(spark, tmp_path, {}, ["a"]) == {}
