import random
from collections import defaultdict

import numpy as np
import pytest

from tarazu.llm.chunks import KINDS, Sizes, cut, pieces
from tarazu.llm import packing
from tarazu.llm.packing import TERM_BITS, RoundIndex, ShardIndex, document_vectors, fill, neighbour_recall, pack
from tarazu.llm.tokens import TokenCounter, atoms_of, read_ranks
from tarazu.llm.words import WordHashes

WORDS = "notice of the tender for works at ward office दिनांक पूर्वी विभागाने मंजूर केले आहे प्रभाग".split()


@pytest.fixture(scope="module")
def tokens():
    return TokenCounter(read_ranks())


def prose(rng, n, breaks=True):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + (".\n\n" if breaks and i % 60 == 59 else ".\n" if breaks and i % 23 == 22 else ". " if i % 11 == 10 else " "))
    return "".join(out).strip()


def test_atoms_add_up(tokens):
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choices(["a", "Bc", "दि", "१", "१२", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "-", " ", "‍", "\f"], k=40))
        assert "".join(atoms_of(t)) == t
        assert tokens.count(t) == len(tokens.encoding.encode_ordinary(t))


def check(t, sizes, tokens):
    got = cut(t, sizes, tokens, WordHashes())
    at = 0
    for k, (a, z, n, overlap, kind) in enumerate(got):
        assert a <= at < z and n <= sizes.limit and overlap <= sizes.overlap and kind in KINDS
        assert n == len(tokens.encoding.encode_ordinary(t[a:z]))
        assert (a == at) == (overlap == 0)
        at = z
    assert at == len(t)
    return got


def test_pieces_cover_and_fit(tokens):
    rng = random.Random(2)
    sizes = Sizes(limit=128, overlap=16, least=48)
    got = check(prose(rng, 3000), sizes, tokens)
    assert len(got) > 20 and all(o > 0 for _, _, _, o, _ in got[1:])
    kinds = [k for *_, k in got[:-1]]
    assert kinds.count("paragraph") + kinds.count("line") > 0.7 * len(kinds)
    assert {k for *_, k in check(prose(rng, 2000, breaks=False), sizes, tokens)[:-1]} <= {"sentence", "word"}


def test_words_without_breaks(tokens):
    sizes = Sizes(limit=64, overlap=8, least=16)
    for t in ("a" * 5000, "क" * 3000, "कि" * 2000, "स्थायीसमितीने05306731549" * 80, "x" * 10, "\n" * 3000, " " * 4000 + "end", "漢" * 3000, "🙂" * 900):
        check(t, sizes, tokens)
    for a, z, *_ in cut("कि" * 2000, sizes, tokens, WordHashes()):
        assert a == 0 or "कि"[a % 2] != "ि"


def lost_cuts(t, at, inserted, sizes, tokens):
    old = {z for _, z, *_ in cut(t, sizes, tokens, WordHashes())[:-1]}
    new = cut(t[:at] + inserted + t[at:], sizes, tokens, WordHashes())[:-1]
    return len(old - {z if z <= at else z - len(inserted) for _, z, *_ in new})


@pytest.mark.parametrize("kind", ["prose", "sentences", "letters", "akshara"])
def test_an_edit_stays_local(tokens, kind):
    rng = random.Random(3)
    t = {
        "prose": lambda: prose(rng, 6000),
        "sentences": lambda: prose(rng, 6000, breaks=False),
        "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000)),
        "akshara": lambda: "".join(rng.choices(["क", "कि", "स्था", "मी", "न", "०", "ल"], k=6000)),
    }[kind]()
    sizes = Sizes(limit=256, overlap=0, least=96)
    lost = [lost_cuts(t, rng.randrange(len(t)), rng.choice(["x", " two words ", "नवा"]), sizes, tokens) for _ in range(60)]
    assert max(lost) <= 6 and sum(x <= 2 for x in lost) >= 54 and sum(lost) <= 60


def test_sizes_are_checked():
    for bad in (dict(limit=10), dict(limit=100, overlap=100), dict(limit=100, overlap=10, least=95), dict(limit=100, least=0)):
        with pytest.raises(ValueError):
            Sizes(**bad)


def test_piece_rows(spark):
    rng = random.Random(4)
    rows = [(1, prose(rng, 900), "a"), (2, "short", "b"), (3, None, "c"), (4, "", "d"), (2, "short", "b"), (None, "x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pieces(df, "doc_id", "text", Sizes(128, 16, 48)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == {1, 2, None} and len(by[2]) == 2 and len(by[1]) > 5
    whole = sorted(by[1], key=lambda r: r["piece"])
    assert all(r["text"] == rows[0][1][r["char_start"] : r["char_end"]] for r in whole)
    assert {r["doc_id"] for r in pieces(df, "doc_id", "text", Sizes(128, 16, 48), oversized_only=True).collect()} == {1}
    assert pieces(df.where("false"), "doc_id", "text").count() == 0


def test_greedy_windows():
    sizes = np.array([5, 5, 4, 3, 3, 2, 1, 1])
    got = fill(sizes, 10, lambda seed: (np.arange(8), np.arange(8.0)))
    assert sorted(i for w in got for i in w) == list(range(8))
    assert all(sizes[w].sum() <= 10 for w in got) and got[0] == [0, 7, 6, 5]  # by score, then the largest that fits
    assert fill(np.array([], int), 10, None) == []
    assert fill(np.array([10, 10]), 10, None) == [[0], [1]]
    assert fill(np.array([6, 4, 3]), 10, lambda s: (np.zeros(0, int), np.zeros(0))) == [[0, 1], [2]]


def test_windows_hold_everything_once():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 60, rng.integers(1, 200))
        near = lambda seed: (at := rng.permutation(len(sizes))[:20], rng.random(20)[: len(at)])
        got = fill(sizes, 64, near)
        assert sorted(i for w in got for i in w) == list(range(len(sizes))) and all(sizes[w].sum() <= 64 for w in got)


def bm25(rng, n, vocabulary=30, size=8):
    docs = [np.unique(rng.choices(range(vocabulary), k=size)).astype(np.int32) for _ in range(n)] + [np.zeros(0, np.int32)]
    counts = [np.array(rng.choices(range(1, 4), k=len(d)), np.uint16) for d in docs]
    lengths = np.array([c.sum() for c in counts], float)
    idf = np.linspace(0.1, 3, 1 << TERM_BITS).astype(np.float32)
    return docs, counts, lengths, idf


def test_bm25_against_brute_force(monkeypatch):
    docs, counts, lengths, idf = bm25(random.Random(5), 20)
    index = ShardIndex(docs, counts, lengths, idf, lengths.mean())
    gone = np.zeros(len(docs), bool)
    gone[[3, 7]] = True
    for round_ in range(3):
        if round_ == 1:
            index.drop(gone)
        if round_ == 2:  # few postings read, the candidates scored by all terms
            monkeypatch.setattr(packing, "POSTINGS", 12)
            monkeypatch.setattr(packing, "CANDIDATES", 4)
        for seed in range(len(docs)):
            want = np.zeros(len(docs))
            for j in range(len(docs)):
                for t, c in zip(docs[j], counts[j].astype(float)):
                    if t in docs[seed] and not (round_ and gone[j]):
                        want[j] += idf[t] * c * 2.2 / (c + 1.2 * (1 - 0.75 + 0.75 * lengths[j] / lengths.mean()))
            found, scores = index.like(seed)
            assert np.allclose(scores, want[found], rtol=1e-4)
            if round_ < 2:
                assert set(found) == set(np.nonzero(want)[0])


def test_packing(spark, tokens):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 120)), 1) for i in range(300)] + [(1000, prose(rng, 2500), 1), (1001, None, 1), (1002, "", 1), (5, None, 1)]
    rows += [rows[7]] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = pack(df, "doc_id", "text", 256, shard_docs=120).collect()
    size = {i: tokens.count(t) for i, t, _ in rows if t}
    held, where = defaultdict(int), defaultdict(list)
    for r in got:
        held[r["container_id"]] += r["n_tokens"]
        where[r["doc_id"]].append(r)
    assert set(where) == set(size) and max(held.values()) <= 256
    for i, n in size.items():
        assert sum(r["n_tokens"] for r in where[i]) == n
        assert sorted(r["token_start"] for r in where[i]) == list(range(0, n, 256))
        assert len(where[i]) == (1 if n <= 256 else -(-n // 256)) == where[i][0]["n_parts"]
    assert sum(size.values()) / (256 * len(held)) > 0.95
    again = pack(df.repartition(5, "text"), "doc_id", "text", 256, shard_docs=120).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert pack(df.where("false"), "doc_id", "text", 256).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", 0)


def test_documents_about_the_same_share_a_shard(spark):
    rng = random.Random(8)
    topics = [[f"t{t}word{i}" for i in range(60)] for t in range(6)]
    rows = [(i, " ".join(rng.choices(topics[i % 6] + WORDS, k=60))) for i in range(600)] + [(1000 + i, "copy of one notice") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share, score = neighbour_recall(df, "doc_id", "text", seeds=100, shard_docs=250)
    assert share > 0.8 and score > 0.95
    assert neighbour_recall(df, "doc_id", "text", seeds=100) == (1.0, 1.0)  # one shard, read whole
    held = pack(df, "doc_id", "text", 512, shard_docs=40).collect()
    shards = defaultdict(set)
    for r in held:
        shards[r["container_id"].rpartition("-")[0]].add(r["doc_id"])
    assert max(map(len, shards.values())) <= 120 and sum(map(len, shards.values())) == 900  # also the group of copies
    same = defaultdict(set)
    for r in held:
        if r["doc_id"] < 600:
            same[r["container_id"]].add(r["doc_id"] % 6)
    assert sum(len(x) == 1 for x in same.values()) > 0.8 * len(same)


def test_shards_are_bounded_by_their_terms(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(120)]
    monkeypatch.setattr(packing, "SHARD_POSTINGS", 2000)
    held = pack(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4096).collect()
    shards = defaultdict(set)
    for r in held:
        shards[r["container_id"].rpartition("-")[0]].add(r["doc_id"])
    assert sum(map(len, shards.values())) == 120 and max(map(len, shards.values())) <= 25


@pytest.mark.parametrize("postings, candidates", [(300_000, 384), (1, 1), (40, 4)])
def test_no_neighbour_is_left_out_of_a_search(monkeypatch, postings, candidates):
    monkeypatch.setattr(packing, "POSTINGS", postings)
    monkeypatch.setattr(packing, "CANDIDATES", candidates)
    rng = random.Random(11)
    docs, counts, lengths, idf = bm25(rng, 60)
    index = ShardIndex(docs, counts, lengths, idf, lengths.mean())
    sizes = np.array([rng.randrange(1, 9) for _ in docs])
    for seed in range(len(docs)):
        want = np.zeros(len(docs))
        for j in range(len(docs)):
            for t, c in zip(docs[j], counts[j].astype(float)):
                if t in docs[seed]:
                    want[j] += idf[t] * c * 2.2 / (c + 1.2 * (1 - 0.75 + 0.75 * lengths[j] / lengths.mean()))
        assert set(index.like(seed)[0]) == set(np.nonzero(want)[0])
        fits = (np.arange(len(docs)) != seed) & (sizes <= rng.randrange(2, 9))
        all_ = np.sort(want[fits & (want > 0)])[::-1]
        for most in (1, 5, 100):
            found, scores, whole = index.nearest(index.terms(seed), fits, sizes, most)
            assert fits[found].all() and np.allclose(scores, want[found], rtol=1e-4)
            assert np.allclose(scores, all_[:most], rtol=1e-4) and len(scores) == min(most, len(all_))
            assert whole == (len(all_) <= most)
            found, scores, _ = index.nearest(index.terms(seed), fits, sizes, most, frequent=next(index.together([seed])))
            assert fits[found].all() and np.allclose(scores, all_[:most], rtol=1e-4) and len(scores) == min(most, len(all_))
            if len(all_) > 3:
                least = all_[2] * (1 - 1e-3)
                found, scores, whole = index.nearest(index.terms(seed), fits, sizes, most, least)
                assert np.allclose(scores, all_[all_ >= least * packing.SLACK][:most], rtol=1e-4)


@pytest.mark.parametrize("cells, dense, block", [(1 << 25, 1024, 64), (1 << 25, 1024, 2), (0, 1024, 64), (400, 1, 2)])
def test_a_round_finds_what_a_shard_finds(monkeypatch, cells, dense, block):
    monkeypatch.setattr(packing, "CELLS", cells)
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    rng = random.Random(13)
    docs, counts, lengths, idf = bm25(rng, 80)
    copies = [docs[5]] * 9
    docs, counts, lengths = docs + copies, counts + [counts[5]] * 9, np.concatenate((lengths, [lengths[5]] * 9))
    sizes = np.array([rng.randrange(1, 9) for _ in docs])
    gone = np.array([rng.random() < 0.2 for _ in docs])
    arrays = document_vectors(docs, counts, lengths, idf, 8.0)
    # What lies on disk between the rounds: eight bytes a term of a document.
    assert sum(x.nbytes for x in arrays.values()) <= 8 * (sum(map(len, docs)) + len(docs) + 1) + 4 * len(arrays["vocabulary"])
    shard, whole_shard = ShardIndex(docs, counts, lengths, idf, 8.0), ShardIndex(docs, counts, lengths, idf, 8.0)
    shard.drop(gone)
    for most in (1, 5, 100):
        asked = []
        for seed in range(len(docs)):
            least = float(rng.choice([0.0, np.sort(whole_shard.like(seed)[1])[-3:][0] if len(docs[seed]) else 0.0]))
            asked.append((seed, rng.randrange(0, 7), least))
        index = RoundIndex({k: x.tobytes() for k, x in arrays.items()}, sizes, ~gone & (sizes <= 6))
        assert set(index.live) == set(np.nonzero(~gone & (sizes <= 6))[0])  # what fits no seed is not looked at
        got = list(index.nearest([(index.of(docs[seed]), seed, free, least) for seed, free, least in asked], most))
        for (seed, free, least), (found, scores, whole) in zip(asked, got):
            fits = ~gone & (sizes <= free) & (np.arange(len(docs)) != seed)
            want, exact, all_ = shard.nearest(shard.terms(seed), fits, sizes, most, least)
            assert list(found) == list(want) and list(scores) == list(exact)  # to the last bit, so that ties stay ties
            assert whole == all_


def test_partners_come_from_all_shards(spark, monkeypatch):
    rng = random.Random(12)
    topics = [[f"t{t}word{i}" for i in range(40)] for t in range(4)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(topics[i % 4] + WORDS, k=rng.randrange(20, 200)))) for i in range(300)], "doc_id long, text string").cache()
    windows = lambda **k: held(pack(df, "doc_id", "text", 1024, **k))
    once = windows()
    assert sorted(i for w in once for i, _ in w) == list(range(300))
    assert windows(shard_docs=30) == once  # the same containers, however many shards
    monkeypatch.setattr(packing, "SEEDS", 64)
    monkeypatch.setattr(packing, "LISTED", 2)  # windows that wait for the next round
    assert sorted(i for w in windows(shard_docs=30) for i, _ in w) == list(range(300))


def held(rows):
    out = defaultdict(list)
    for r in rows.collect():
        out[r["container_id"]].append((r["position"], r["doc_id"]))
    return sorted([(i, p) for p, i in sorted(w)] for w in out.values())
