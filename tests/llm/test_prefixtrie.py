"""The prefix trie against a dictionary of prefixes: random corpora, narrow strips, many shards, hard cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weft.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, key string, conv int, n long, depth int, a long, rep string"


def conversations(spark, rows):
    """Turns with extra columns whose names are used inside."""
    return spark.createDataFrame([(c, t, r, x, "k", 1, 2, 3, 4, "z") for c, t, r, x in rows], SCHEMA)


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, turn_id(r, x), r, x))
    seqs = {c: [(r, x) for _, _, _, r, x in sorted(v)] for c, v in by.items()}
    trunc = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    out = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(trunc(c), [])[:h] + s[h:]
    return out


def brute(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
            for p, m in members.items()
        ), key=str,
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows, **how):
    turns, convs = prefixtrie.graft_heads(*prefixtrie.number_turns(conversations(spark, rows).repartition(3)))
    out = prefixtrie.trie(turns, convs, **how)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def corpus(seed, n, longest, alphabet):
    rng = random.Random(seed)
    rows, seqs = [], []
    for c in range(n):
        s = list(rng.choice(seqs)) if seqs and rng.random() < 0.6 else []
        s = s[: rng.randint(0, len(s))] if rng.random() < 0.7 else s
        s += [(rng.choice("ua"), rng.choice(alphabet)) for _ in range(rng.randint(0, longest))]
        seqs.append(s)
        rows += [(c, i, r, x) for i, (r, x) in enumerate(s)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "cells"), [(1, 16, 1 << 19), (2, 2, 60), (3, 3, 200)])
def test_against_prefix_dictionary(spark, monkeypatch, seed, width, cells):
    monkeypatch.setattr(prefixtrie, "CELLS", cells)
    rows = corpus(seed, 220, 5, ["x", "yy", "zéé"])
    assert got(spark, rows, first_width=width) == brute(rebuilt(rows))


def test_hard_cases(spark):
    long = [(700, i, "u", f"t{i % 3}") for i in range(90)] + [(701, i, "u", f"t{i % 3}") for i in range(90)] + [(702, i, "u", "t0") for i in range(70)]
    rows = [
        (None, 0, "u", "lost"), (0, None, "u", "none first"), (0, -5, None, None), (0, 1, "u", "x" * 100_000), (0, 1, "u", "x" * 100_000), (1, 2, "a", "tie"), (1, 2, "u", "tie"),
        (1, None, "u", None), (1, None, None, "u"), (2, 0, "", ""), (3, 0, None, None), (-7, 0, "u", "neg"), (-107, 0, "u", "neg"), (-100, 3, "u", "head"), (-100, 1, "u", "head 2"),
        (250, 0, "u", "no base"), (251, 0, "u", "no base"), (2**62, 0, "u", "big"), (4, 0, "1:", "2"), (5, 0, "1", ":2"), *long,
    ]
    assert got(spark, rows, first_width=4) == brute(rebuilt(rows))
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "u", "x")]) == []


def test_only_turnless_and_copies(spark):
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert got(spark, [(lone, 0, "u", "dropped")]) == brute({lone: []})
    rows = [(c, t, "u", f"same {t}") for c in range(300) for t in range(7)]
    assert got(spark, rows, first_width=2) == brute(rebuilt(rows))
