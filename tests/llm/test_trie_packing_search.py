"""Prefix trie, best-fit packing and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegrid.llm import balltree, bestfit, trie

TURNS = "conv_id long, turn long, role string, text string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- conversation prefix trie


def rebuilt(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(t)] for c, t in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: tuple(own.get(c - c % group, [])[: heads[c]] + own[c][heads[c] :]) for c in own}


def brute_trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def spark_trie(spark, rows):
    got = trie.prefix_trie(trie.grafted(spark.createDataFrame(rows, TURNS)))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


def conversations(seed, n=160, words=3, most=7):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é日"][:words])) for c in range(n) for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [30, 400_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, monkeypatch, seed, shard_turns):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard_turns)
    rows = conversations(seed, words=1 + seed)
    assert spark_trie(spark, rows) == brute_trie(rebuilt(rows))


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 9000, 100) for t in range(3)]  # 90 copies, over several tasks
    rows += [(50, t, "user", "x" * (t % 5)) for t in range(900)] + [(150, t, "user", "x" * (t % 5)) for t in range(901)]
    assert spark_trie(spark, rows) == brute_trie(rebuilt(rows))


def test_trie_of_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, "x"), (1, 0, None, "x"), (1, 0, "user", None), (1, 2, "user", ""), (2, 1, "user", "first"), (None, 0, "user", "lost"), (700, 0, "user", "é" * 5000), (701, 0, "user", "own"), (799, 3, None, None)]
    assert spark_trie(spark, rows) == brute_trie(rebuilt(rows))
    wide = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "words": F.lit(2), "own": F.lit(3), "h": F.lit(4), "a.b": F.lit(5)})
    assert trie.prefix_trie(trie.grafted(wide)).count() == len(brute_trie(rebuilt(rows)))


def test_trie_of_nothing(spark):
    assert spark_trie(spark, []) == []


def test_find_close_over_many_blocks():
    rng = random.Random(3)
    depth = [0]
    for _ in range(5000):
        depth.append(rng.randint(1, min(depth[-1] + 1, 400)) if rng.random() < 0.05 else depth[-1] + 1)
    shape = trie.Parentheses(np.array(depth))
    close, stack, want = shape.find_close(), [], {}
    for at, bit in enumerate(shape.bits):
        if bit:
            stack.append(at)
        else:
            want[stack.pop()] = at
    assert not stack and [want[p] for p in shape.opens] == close.tolist()


# --- best-fit packing


def pieces_of(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return bestfit.best_fit_pack(docs, VOCABULARY, with_ids=True, **how).collect()


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


ODD = ["Don't, it's 'quoted' (é,ü) x=1,000.50!", "ß İI ı T̈a É ≠ a b　c", "x\x1cy\x0bz\x85w", "<|startoftext|>a<|endoftext|> b", "日本語, 12３4 ٣٤ ½", "—,— é— ,é '' ''s s'S", "", None, "  \n", "́a b́,c"]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = list("abAB ,.'12\n-_éÉñ日́ßÅı") + ["'s", "  ", "<|", "don't", " ", "Å", "T̈"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_have_the_tokenizers_ids(spark, monkeypatch):
    texts = ODD + random_texts(5, 400) + ["word other, " * 3000]
    rows = pieces_of(spark, texts, capacity=50)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(found[r.doc_id]) and r.length == len(ids) and r.piece * 50 == r.start and r.ids_crc32 == zlib.crc32(r.ids)
        found[r.doc_id] += ids
    t = Tokenizer.from_file(VOCABULARY)
    assert [found[i] for i in range(len(texts))] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    check_packing(rows, 50)


def test_long_texts_in_parts_and_forgetting(monkeypatch):
    monkeypatch.setattr(bestfit, "CHUNK", 40)
    monkeypatch.setattr(bestfit, "MOST_WORDS", 30)
    import pyarrow as pa

    texts = [*ODD, "one two, three " * 30, *random_texts(6, 100)]
    t = Tokenizer.from_file(VOCABULARY)
    table = bestfit.WordIds(VOCABULARY)
    monkeypatch.setattr(bestfit, "word_ids", lambda path: table)
    got = {i: ids.tolist() for i, ids in bestfit.token_rows(pa.array(texts, pa.string()), VOCABULARY)}
    assert [got[i] for i in range(len(texts))] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_few_sequences(spark):
    rng = random.Random(8)
    texts = ["a " * min(95, int(rng.expovariate(1 / 30))) for _ in range(1500)]
    rows = pieces_of(spark, texts, capacity=96)
    assert sum(r.length for r in rows) == sum(len(x) // 2 + 1 for x in texts)
    assert check_packing(rows, 96) <= math.ceil(sum(r.length for r in rows) / 96) + 1
    joined = bestfit.packed_sequences(spark.createDataFrame(rows)).collect()
    assert all(len(s.ids) == 4 * s.length and sum(1 for _ in s.parts) for s in joined) and sum(s.length for s in joined) == sum(r.length for r in rows)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_rank_once_and_beats_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100, 4096])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(rng.randint(1, 400))]
    ranks, bins = set(), defaultdict(list)
    for length, first, n, base, each, offset in bestfit.plan_bins(Counter(lengths), capacity):
        for k in range(n):
            assert (length, first + k) not in ranks
            ranks.add((length, first + k))
            bins[base + k // each].append((offset + k % each * length, length))
    assert len(ranks) == len(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in parts) <= 2
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    assert len(bins) <= len(gaps)


def test_packing_of_odd_tables(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "same"), (2, "same"), (3, "x " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit(1), "length": F.lit(2), "_pos": F.lit(3), "ids": F.lit(4)})
    got = bestfit.best_fit_pack(docs, VOCABULARY).collect()
    assert check_packing(got, 4096) == 10 and sum(r.length for r in got) == 3 + 1 + 1 + 2 + 2 + 40_001
    assert bestfit.best_fit_pack(docs.filter("false"), VOCABULARY).collect() == []


# --- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k):
    terms = lambda x: TERM.findall("".join(c.lower() if c.isascii() else c for c in x or ""))
    bags = [(d, Counter(terms(x))) for d, x in docs]
    bags = [(d, b) for d, b in bags if b]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, x in items:
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(x) if b[t])
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def searched(spark, docs, items, k):
    got = balltree.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect())


@pytest.mark.parametrize("tree", [40, 8192])
def test_search_is_that_of_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(balltree, "TREE", tree)
    monkeypatch.setattr(balltree, "LEAF", 4)
    rng = random.Random(tree)
    words = [f"w{i}" for i in range(80)] + ["Été", "日本", "x1"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(3, 83)]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "w1 w2 " * 20_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(90, None), (91, "..."), (92, "unknown"), (93, docs[7][1]), (94, "w1 " * 500)]
    monkeypatch.setattr(balltree, "BLOCK", 11)
    assert searched(spark, docs, items, 10) == brute_search(docs, items, 10)


def test_search_prunes_whole_subtrees():
    rng = np.random.default_rng(2)
    size, n = 60, 2000
    group = rng.integers(0, 20, n)
    term = np.stack([3 * group, 3 * group + 1, 3 * group + 2], 1).ravel()
    impact = rng.integers(900, 1000, 3 * n)
    tree = balltree.BallTree(np.arange(n), np.arange(0, 3 * n + 1, 3), term, impact, np.ones(size))
    wanted, whole = np.array([9, 10, 11]), np.zeros(size, np.int64)
    whole[wanted] = 1
    bound = tree.bounds(wanted, np.ones(3))
    ids, scores = tree.search(bound, whole, 5, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    total = np.where(group == 3, impact.reshape(n, 3).sum(1), 0)
    assert scores.tolist() == sorted(total.tolist(), reverse=True)[:5]
    leaves = np.flatnonzero(tree.children == 0)
    assert (bound[leaves] >= scores[-1]).sum() < 0.3 * len(leaves)
    # bounds hold for every document of every node
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), 3), tree.term] = tree.impact
    for a, b, most in zip(tree.first, tree.last, bound, strict=True):
        assert (dense[a:b] @ whole).max() <= most


def test_search_of_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit(2)})
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string").withColumns({"qrow": F.lit(7), "a.b": F.lit(8), "score": F.lit(9), "_pos": F.lit(3)})
    got = balltree.ranked_search(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id, r.qrow, r["a.b"], r._pos) for r in got] == [(1, 1, 2, 7, 8, 3), (1, 2, 1, 7, 8, 3)]
    assert balltree.ranked_search(docs.filter("false"), items).collect() == []
    assert balltree.ranked_search(docs, items.filter("false")).collect() == []
