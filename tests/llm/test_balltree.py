"""Ranked search against exhaustive scoring, bounds against products, hard cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weft.llm import balltree

DOCS = "doc_id long, text string, n long, terms string, item int, score long, id long"
ITEMS = "item_id long, text string, rank int, part int, id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    """Documents with extra columns whose names are used inside."""
    return spark.createDataFrame([(i, t, 5, "x", 4, 3, 2) for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 9, 8, 7) for i, t in rows], ITEMS)


def brute(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    words = [(i, Counter(w)) for i, w in ((i, split(t)) for i, t in docs) if w]
    n_docs, n_terms = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in words:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=10, parts=6):
    return sorted(map(tuple, balltree.top_k(docs_of(spark, docs).repartition(parts), items_of(spark, items), k).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["alpha", "Beta", "été", "x1", "naïve", "zwölf", "the"]
    rare = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 12))
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", "\n", "-", "..."]).join(words)))
    return docs, [(j, " ".join(rng.choices(common + rare, k=rng.randint(1, 20)))) for j in range(15)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_exhaustive_scoring(spark, seed):
    docs, items = corpus(seed, 900)
    docs += [(1000 + i, docs[i % 3][1]) for i in range(200)]  # large groups of copies: ties
    assert got(spark, docs, items) == brute(docs, items, 10)


def test_several_parts_of_items_and_small_runs(spark, monkeypatch):
    docs, items = corpus(3, 300)
    monkeypatch.setattr(balltree, "ITEM_BYTES", 300)
    assert len(balltree._parts(items_of(spark, items), "item_id", "text")) > 2
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_hard_cases(spark):
    docs = [
        (None, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (3, " .,;! "), (4, "alpha beta"), (4, "alpha beta"), (4, "alpha"), (5, "ALPHA\x00beta\x7fÀlpha"),
        (6, "alpha " * 50_000), (7, "beta" * 2_000_000), (8, "a_b@c[d"), (-9, "alpha beta"), (10, "ǅ É é"),
    ]
    items = [(1, "Alpha beta beta"), (1, "Alpha beta beta"), (1, "a b c d"), (None, "alpha"), (2, None), (3, ""), (4, "?!"), (5, "É ǅ Àlpha"), (6, "absent"), (7, "beta" * 2_000_000)]
    assert got(spark, docs, items, 4) == brute(docs, items, 4)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []


def test_terms_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"w{i}é" * (1 + i % 90) for i in range(500)).encode()
    whole = [w for ws in balltree.terms_of(text) for w in ws]
    monkeypatch.setattr(balltree, "_PIECE", 37)
    assert [w for ws in balltree.terms_of(text) for w in ws] == whole == text.split()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows, width = 3000, 400
    topics = rng.integers(0, 20, rows)
    sizes = rng.integers(18, 25, rows)
    terms = np.concatenate([np.sort(rng.choice(20, min(s, 20), replace=False)) + 20 * t for s, t in zip(sizes, topics, strict=True)])
    sizes = np.minimum(sizes, 20)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    values = rng.integers(9 * 10**8, 10**9, len(terms))
    dense = np.zeros((rows, width), object)
    for i in range(rows):
        dense[i, terms[edges[i] : edges[i + 1]]] = values[edges[i] : edges[i + 1]]
    tree = balltree.BallTree(edges, terms, values, 32)
    visited = 0
    for topic in range(20):
        q_terms, counts = np.arange(20) + 20 * topic, rng.integers(1, 5, 20)
        truth = dense[:, q_terms] @ counts.astype(object)
        at = np.searchsorted(tree.known, q_terms)
        bound = tree.bounds(at, counts)
        for (a, b), limit in zip(tree.spans, bound, strict=True):
            assert limit >= max(truth[tree.order[a:b]])
        best, search = balltree.Best(10), tree.search(q_terms, counts, 1)
        found = next(search)
        while found:
            visited += len(found[0])
            assert found[1].tolist() == truth[found[0]].tolist()
            try:
                found = search.send(best.add(found[1], found[0], np.zeros(len(found[0]), bool)))
            except StopIteration:
                break
        want = sorted(((-s, i) for i, s in enumerate(truth)))[:10]
        assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want
    assert visited < 0.5 * 20 * rows  # most subtrees are never opened


def test_sums_beyond_doubles_are_exact():
    edges, terms = np.array([0, 2, 3]), np.array([0, 1, 1])
    values = np.array([2**60 + 1, 3, 2**60 + 2])
    tree = balltree.BallTree(edges, terms, values)
    rows, scores = next(tree.search(np.array([0, 1]), np.array([1, 1]), 1))
    assert dict(zip(rows.tolist(), scores.tolist(), strict=True)) == {0: 2**60 + 4, 1: 2**60 + 2}
