import random
from collections import defaultdict

import numpy as np
import pytest

from tarazu.llm import containment as ct
from tarazu.llm.words import WordHashes, shingle_hashes, sliding_min, words

VOCAB = [f"w{i}" for i in range(400)]


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, s in items:
            v = words(s or "")
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: rng.choices(VOCAB, k=n)
    items = [(i, text(rng.randrange(12, 60))) for i in range(30)]
    docs = []
    for d in range(200):
        w = text(rng.randrange(0, 300))
        if d % 4 == 0:
            _, v = rng.choice(items)
            n = rng.choice([10, 11, 12, 13, len(v)])
            k = rng.randrange(0, max(1, len(v) - n + 1))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = v[k : k + n]
        glue = [rng.choice([" ", "  ", "\n", ", ", " ​", "\f", ". "]) for _ in w]
        docs.append((d, "".join((x.upper() if rng.random() < 0.2 else x[0] + "‍" + x[1:]) + g for x, g in zip(w, glue))))
    return docs, [(i, " ".join(v)) for i, v in items]


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS size", "'x' AS window")
    i = spark.createDataFrame(items, "item_id long, text string")
    return ct.contained_items(d, "doc_id", "text", i, "item_id", "text", **more)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    items += [(800, None), (801, ""), (802, "too short"), (803, items[1][1])]
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).collect()}
    want = brute(docs, items, 12)
    assert got == want and len(want) > 20


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(ct, "BLOCK_WORDS", 150)
    monkeypatch.setattr(ct, "MOST_MATCHES", 20)
    assert {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).collect()} == brute(docs, items, 12)


def test_short_items(spark):
    docs = [(1, "zero one two three four five six seven"), (2, "one two three four"), (3, "two three four five six x")]
    items = [(10, "one two three four five six"), (11, "two three four five six"), (12, "four words are few")]
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in found(spark, docs, items, threshold=1.0).collect()}
    assert got == {(1, 10): 1.0, (1, 11): 1.0, (3, 11): 1.0}
    assert {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items, threshold=0.5).collect()} == {(1, 10), (1, 11), (3, 11), (3, 10)}


def shares(docs, items):
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    held = {i: grams(words(t)) for i, t in items}
    for d, t in docs:
        g = grams(words(t))
        for i, own in held.items():
            if own:
                yield d, i, len(own & g) / len(own)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_recall_of_edited_passages(spark, threshold):
    """Whole items with words replaced, dropped and added in long documents."""
    rng = random.Random(6)
    items = [(i, rng.choices(VOCAB, k=rng.choice([8, 20, 35, 70, 105, 300]))) for i in range(120)]
    docs = []
    for d in range(600):
        w = rng.choices(VOCAB, k=rng.randrange(0, 1500))
        v = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 1 + len(v) // 12)):
            k = rng.randrange(len(v))
            v[k : k + rng.choice([0, 1, 1, 2])] = rng.choices(VOCAB, k=rng.choice([0, 1]))
        at = rng.randrange(0, len(w) + 1)
        w[at:at] = v
        docs.append((d, " ".join(w)))
    items = [(i, " ".join(v)) for i, v in items]
    want = {(d, i): round(s, 9) for d, i, s in shares(docs, items) if s >= threshold}
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 9) for r in found(spark, docs, items, run=None, threshold=threshold).collect()}
    assert got.items() <= want.items() and len(want) > 300
    assert len(got) >= 0.99 * len(want)


def test_sketches_by_size():
    assert [ct.window_width(n, None) for n in (1, 8, 17, 40, 100, 1000)] == [1, 1, 1, 3, 7, 63]
    assert [ct.window_width(n, 12) for n in (1, 8, 17, 40, 100, 1000)] == [1, 1, 1, 3, 7, 8]


def test_equal_items_are_each_reported(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "x " + item.upper() + " y"), (1, "x " + item + " y"), (2, item[:-3])]
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, [(5, item), (6, item.replace(" ", ", ")), (6, "other")]).collect()}
    assert got == {(1, 5), (1, 6)}


def test_counts_long_texts_and_nothing(spark):
    rng = random.Random(4)
    item = " ".join(rng.choices(VOCAB, k=40))
    long = " ".join(rng.choices(VOCAB, k=60000)) + " " + item + " " + item
    got = found(spark, [(1, long), (2, "x")], [(1, item)]).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"], r["n_windows"], r["containment"]) for r in got] == [(1, 1, 40, 29, 1.0)]
    assert found(spark, [(1, long)], [(None, item), (2, None)]).count() == 0
    with pytest.raises(ValueError):
        found(spark, [(1, "x")], [(1, "y")], run=4)
    with pytest.raises(ValueError):
        found(spark, [(1, "x")], [(1, "y")], run=None)


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 13, 200):
        assert sliding_min(a, width).tolist() == [min(a[i : i + width].tolist()) for i in range(len(a) - width + 1)]
    assert len(sliding_min(a, 201)) == 0


def test_equal_runs_have_equal_hashes():
    h = WordHashes(most=3)
    a, b = h.of(list("abcdefgh")), h.of(list("xxbcdefgh"))
    assert shingle_hashes(a, 5)[1] == shingle_hashes(b, 5)[2]
    assert len(shingle_hashes(a[:3], 5)) == 0 and defaultdict(int)["x"] == 0
