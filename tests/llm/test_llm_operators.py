"""Edge cases and brute-force comparisons of the corpus operators."""

import base64
import hashlib
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegrid.llm import bm25, common, components, embeddings, hnsw, langid, lines, minhash, mixing, packing, sharding, suffix, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 3000
COPY = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun until noon"
ROWS = [
    (1, COPY, "en", "a", 1, "x", None), (2, COPY, "en", "a", 1, "x", None), (2, COPY, "en", "a", 1, "x", None), (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, None),
    (None, COPY + " today", "en", None, 1, None, None), (5, LONG, "la", "b", 1, None, None), (6, "  \n\t", "en", "b", 1, None, None), (7, "one two", "en", "c", 1, None, None), (7, "one two three", "en", "c", 1, None, None),
    (100, COPY + "\nA line that is frequent enough\nx", "en", "c", 1, None, None), (200, "A LINE THAT IS FREQUENT ENOUGH  \nother", "en", "c", 1, None, None), (8, "a line that is frequent enough", "en", "c", 1, None, None), (9, "été à Île 12345 — ñandú 日本", "fr", "é", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "lines": lambda d: lines.dedup_lines(d),
    "mix": lambda d: mixing.mix_plan(d, block_words=2),
    "mixed": lambda d: mixing.mix_documents(d, block_words=2),
    "pack": lambda d: packing.pack(d),
    "shards": lambda d: sharding.shuffle_to_shards(d, shards=3, bucket_bytes=1000),
    "minhash": lambda d: minhash.near_duplicates(d),
    "langid": lambda d: langid.identify(d),
    "suffix": lambda d: suffix.erase_repeats(d),
    "bm25": lambda d: bm25.search(d.select("doc_id", "text"), d.filter("doc_id % 100 = 0"), k=3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, empty):
    assert OPERATORS[name](empty).collect() == []


CLASHES = ["_id", "_rk", "id", "rk", "gone", "_gone", "copy", "copies", "words", "_at", "_bucket", "at", "bucket", "rank", "score", "query_id", "shard", "slot", "lines", "_row", "text2", "n", "label", "kept"]


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_may_have_any_name(name, docs, request):
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    shared = [c for c in OPERATORS[name](plain).columns if c not in ("rk", "batch", "slot", "shard")]
    a, b = (sorted(map(str, OPERATORS[name](d).select(*shared).collect())) for d in (plain, wide))
    if name in ("mix", "mixed"):  # a row's digest orders the mix
        assert len(a) > 0 and len(b) > 0
    elif name == "pack":
        assert len(a) == len(b)
    else:
        assert a == b


def test_lines(docs):
    got = {(r.doc_id, r.n_lines): r for r in lines.dedup_lines(docs).collect()}
    assert len(lines.dedup_lines(docs).collect()) == len(ROWS)
    assert got[100, 3].n_dropped == 1 and got[100, 3].kept_text == COPY + "\nx"
    assert got[200, 2].n_dropped == 0 and got[8, 1].n_dropped == 1 and got[8, 1].kept_text == ""
    assert got[3, 1].text is None and got[3, 1].kept_text == "" and got[4, 1].kept_text == ""
    # the frequent text of 1 and 2 is in 100 as well
    assert got[1, 1].n_dropped == 1 and got[2, 1].n_dropped == 1


def test_fresh_hashes_settle_the_keeper(spark):
    rows = [(k % 17, k % 5, 400 - k) for k in range(400)]
    frame = spark.createDataFrame(rows, "h1 long, h2 long, id long")
    runs, flat = lines.LineRuns(spark, fanout=2), lines.LineRuns(spark, fanout=99)
    named = 0
    for lo in (320, 240, 160, 80, 0):
        batch = frame.filter(F.col("id").between(lo + 1, lo + 80))
        runs.add(batch)
        named += flat.add(batch).filter("keeper is not null").count()
    got = {(r.h1, r.h2): (r.docs, r.keeper) for r in runs.totals().collect()}
    want = {}
    for a, b, i in rows:
        n, top = want.get((a, b), (0, -1))
        want[a, b] = (n + 1, max(top, i))
    assert got == want and named == len(want) and len(runs.levels) > 1


def test_runs_are_merged_where_they_lie(spark):
    """Only a new batch is shuffled and sorted: no run is, and merging runs needs neither."""
    frame = spark.range(4000).select((F.col("id") % 700).alias("h1"), (F.col("id") % 700 * 3).alias("h2"), (-F.col("id")).alias("id"))
    runs = lines.LineRuns(spark)
    for lo in (0, 1000, 2000):
        runs.add(frame.filter(F.col("id").between(-lo - 999, -lo)))
    with common.ordered_buckets(spark):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        batch, totals = plan(runs.counted(frame.filter("id <= -3000"))), plan(runs.totals())
    assert sum(map(len, runs.levels)) == 2 and batch.count("SortMergeJoin") == 2 and batch.count("Exchange") == 2 and batch.count("Sort [") == 1
    assert totals.count("SortMergeJoin") == 1 and "Exchange" not in totals and "Sort [" not in totals
    assert runs.totals().agg(F.sum("docs")).first()[0] == 3000
    tables = {t.name for t in spark.catalog.listTables()}
    runs.remove()
    assert tables - {t.name for t in spark.catalog.listTables()} == {r._pagegrid_table for level in runs.levels for r in level}


def test_batches_follow_the_rows(docs):
    few, many = (sorted(map(str, lines.dedup_lines(docs, batch_rows=n).select("doc_id", "n_dropped", "kept_text").collect())) for n in (50_000_000, 2))
    assert few == many


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(3)
    for _ in range(4):
        votes = [float(rng.choice([0, 1, 5, 37, 1000])) * rng.random() for _ in range(7)]
        seats = rng.randrange(0, 40)
        frame = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, p int, votes double, seats long")
        got = {r.p: r.won for r in mixing.sainte_lague(frame, ["g"], ["p"]).collect()}
        top = sorted(((v / (s + 0.5), -i) for i, v in enumerate(votes) for s in range(seats) if v > 0), reverse=True)[:seats]
        want = {i: sum(-j == i for _, j in top) for i in range(7)}
        assert got == want


def test_mix(docs):
    rows = mixing.mix_plan(docs, block_words=2).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    total = sum(k[1] for k in by)
    assert abs(sum(k[2] for k in by) - total) < 1e-6
    assert all(abs(sum(v) - k[2]) <= 8 for k, v in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs, block_words=2).collect()))
    texts = mixing.mix_documents(docs, block_words=2).collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in rows)


def test_mix_meets_targets_over_many_shards(spark):
    # a small source of short documents beside a large one: 120 shards of 8 blocks by the whole table's size
    small, tiny, large = ([(k, " ".join(["w"] * n), s) for k in range(i, i + m)] for i, m, n, s in ((0, 150, 30, "a"), (1000, 1, 5, "b"), (2000, 500, 110, "c")))
    frame = spark.createDataFrame([*small, *tiny, *large, (None, None, None)], "doc_id long, text string, source string")
    params = dict(block_words=64, shard_words=512)
    rows = mixing.mix_plan(frame, **params).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert len(by) == 4 and all(abs(sum(v) - target) <= 128 for (_, target), v in by.items())
    assert sum(sum(v) for (s, _), v in by.items() if s == "a") == 3 * 150 * 30
    texts = mixing.mix_documents(frame, **params).collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in rows)


def test_bucket_program_is_optimal():
    rng = np.random.default_rng(0)
    hist = np.array([(n, n * top, top) for top, n in zip(sorted(rng.choice(60, 9, replace=False)), rng.integers(1, 9, 9), strict=True)])
    from itertools import combinations

    def cost(bounds):
        return sum(int(n) * (min(b for b in bounds if b >= t) - int(t)) for n, _, t in hist)

    best = min(cost([*c, hist[-1, 2]]) for k in range(3) for c in combinations(hist[:-1, 2], k))
    assert cost(packing.choose_buckets(hist, 3)) == best


def test_pack(docs):
    rows = packing.pack(docs, buckets=3, batch_words=64).collect()
    assert len(rows) == len(ROWS) and all(r.padding == r.padded_length - r.length >= 0 for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.batch), []).append(r)
    for g in groups.values():
        assert sorted(r.slot for r in g) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g[0].padded_length <= 64


def test_pack_is_optimal_beside_one_long_text(spark):
    lengths = [1, 2, 2, 3, 5, 5, 8, 9, 9, 9, 14, 20, 9000]
    frame = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    from itertools import combinations

    best = min(sum(min(b for b in [*c, 9000] if b >= n) - n for n in lengths) for c in combinations(sorted(set(lengths))[:-1], 3))
    assert sum(r.padding for r in packing.pack(frame, buckets=4).collect()) == best


def test_bucket_program_on_many_lengths():
    rng = np.random.default_rng(5)
    for m, k in ((1, 3), (2, 2), (7, 4), (60, 1), (120, 6), (300, 12)):
        top = np.sort(rng.choice(2000, m, replace=False))
        n = rng.integers(1, 50, m)
        rows, words = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * top))
        best = np.array([0, *[10**15] * m])
        for _ in range(k):
            best = np.array([0, *[min(best[i] + top[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i]) for i in range(j)) for j in range(1, m + 1)]])
        bounds = np.array(packing.choose_buckets(np.stack([n, n * top, top], 1), k))
        assert len(bounds) <= k and ((bounds[np.searchsorted(bounds, top)] - top) * n).sum() == best[m]


def test_fisher_yates_is_a_permutation():
    for n in (0, 1, 2, 50):
        assert sorted(sharding.fisher_yates(n, np.random.default_rng(1)).tolist()) == list(range(n))


def test_shards(docs):
    rows = sharding.shuffle_to_shards(docs, shards=3, bucket_bytes=1000).collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(r[:2]) for r in ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(3)]
    assert max(sizes) - min(sizes) <= 1


def test_minhash(docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert by[3].n_shingles == by[4].n_shingles == by[6].n_shingles == 0 and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept


def test_strays_link_whatever_their_signatures():
    import pyarrow as pa

    # strays 1-3 and members 11-14 of one bucket; center 99 is elsewhere. Signatures that agree nowhere lose no link.
    text = {1: "a b c d e f g h", 2: "a b c d e f g", 3: "q r s t u v", 11: "a b c d e f g h i", 12: "a b c", 13: "q r s t u v w x y z", 14: "a b c d e f g z"}
    rows = [(7, 0, 0, int(i > 9), i, i, 99, int(i < 9), t) for i, t in text.items() if i < 9] + [(7, 0, 0, 1, i, i, 99, int(i < 9), t) for i, t in text.items()]
    names = ["band", "block", "part", "role", "cid", "label", "center", "minor"]
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(8)]
    sig = pa.array([bytes([r[4]] * 128) for r in rows], pa.binary())
    batch = pa.record_batch([*cols, pa.array([r[8] for r in rows]), pa.array([[7, r[4]] for r in rows], pa.list_(pa.int64())), sig], names=[*names, "text", "bands", "sig"])
    sets = {i: set(t.split()) for i, t in text.items()}
    want = {(max(a, b), min(a, b)) for a in (1, 2, 3) for b in sets if a != b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    got = [x for out in minhash.stray_links(iter([batch]), 1, 75) for x in zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True)]
    assert len(got) == len(want) == len(set(got)) and set(got) == want and (11, 1) in want


def test_components_both_ways(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(edges, "u long, v long")
    for limit in (0, 1000):
        assert {r.node: r.component for r in components.connected_components(frame, one_task=limit).collect()} == want


def test_language(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[3].score == 0
    assert got[9].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("frequent", [{}, {"sample": 1, "frequent_runs": 3}])
def test_suffix_against_brute_force(spark, frequent):
    rng = random.Random(11)
    base = "".join(rng.choice("abé ") for _ in range(400))
    texts = [(i, "".join(base[(s := rng.randrange(300)) : s + rng.randrange(20, 120)] if rng.random() < 0.6 else rng.choice("xyzü") * rng.randrange(1, 130) for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [(None, base), (5, base), (41, None), (42, "")]
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.erase_repeats(spark.createDataFrame(texts, "doc_id long, text string"), **frequent).collect()}
    order = [(2**63 if d is None else d, (t or "").encode(), d) for d, t in texts]
    first = {}
    for k, b, _ in order:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, k), k)
    want = set()
    for k, b, d in order:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                hit[i : i + 50] = True
        spans = int(hit[0] if len(hit) else 0) + int((hit[1:] & ~hit[:-1]).sum())
        want.add((d, len(b), int(hit.sum()), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    assert got == want


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", *[f"w{k}" for k in range(40)]]) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(None, "the of"), (301, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in bm25.search(frame, frame.filter("doc_id % 100 = 0"), k=5, shards=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    docs = {d: t.split() for d, t in rows if d is not None and t is not None}
    n, mean = len(rows), sum(len(t) for t in docs.values()) / len(rows)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for q in (0, 100, 200):
        scores = {}
        for d, t in docs.items():
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(docs[q]) if w in t)
            if s > 0:
                scores[d] = round(float(s), 6)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(d, s) for _, d, s in sorted(got.get(q, []))] == pytest.approx(want) if not want else [d for _, d, _ in sorted(got[q])] == [d for d, _ in want]


def test_bm25_unpacks_one_segment_at_a_time(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)]) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    monkeypatch.setattr(bm25, "SEGMENT_DOCS", 50)
    monkeypatch.setattr(bm25, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    parts = list(bm25.index_segments([pa.record_batch([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])], "text"))
    terms = np.unique(bm25.terms_of(*bm25.bytes_of(pa.array(texts)), {})[0])
    asks = [(q, rng.sample(terms.tolist(), 12)) for q in range(40)]
    held = [p.append_column("kind", pa.array([0])).append_column("idf", pa.array([None], pa.binary())).append_column("qrow", pa.array([None], pa.int64())) for p in parts]
    bits = lambda x, t: np.array(x, t).tobytes()
    columns = {"kind": [1] * 40, "qrow": [q for q, _ in asks], "terms": [bits(t, np.int64) for _, t in asks], "idf": [bits(np.arange(1, 13) / 7, float) for _ in asks]}
    asking = [pa.record_batch([pa.array(x) for x in columns.values()], names=list(columns)).slice(a, 20) for a in (0, 20)]
    alive, most, unpack = weakref.WeakSet(), [0], bm25.Segment.__init__

    def counted(self, *a, **b):
        unpack(self, *a, **b)
        alive.add(self)
        most[0] = max(most[0], len(alive))

    monkeypatch.setattr(bm25.Segment, "__init__", counted)
    got = {}
    for out in bm25.search_shard(iter(held + asking), k=5, k1=1.2, b=0.75, mean=150.0):
        for r in out.to_pylist():
            got.setdefault(r["qrow"], []).append((r["score"], r["doc_id"]))
    assert len(parts) == 8 and most[0] <= 2  # the next one is unpacked before the last one goes
    key = {w: int(bm25.terms_of(*bm25.bytes_of(pa.array([w])), {})[0][0]) for w in {w for t in texts for w in t.split()}}
    count = [{key[w]: t.split().count(w) for w in set(t.split())} for t in texts]
    for q, t in asks:
        norm = [1.2 * (0.25 + 0.75 * sum(c.values()) / 150.0) for c in count]
        every = [(round(sum(i / 7 * c[x] * 2.2 / (c[x] + n) for i, x in enumerate(t, 1) if x in c), 6), d) for d, (c, n) in enumerate(zip(count, norm, strict=True))]
        want = sorted((x for x in every if x[0] > 0), key=lambda x: (-x[0], x[1]))[:5]
        assert [d for _, d in got[q]] == [d for _, d in want] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], abs=2e-6)


def test_bm25_deals_segments_evenly():
    sizes = [12, 1] * 8  # a full segment and a rest from each partition
    shards = bm25.dealt(sizes, 4)
    assert [sum(n for n, s in zip(sizes, shards, strict=True) if s == k) for k in range(4)] == [26] * 4
    assert bm25.dealt([], 3) == []


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    v = np.repeat(base, 6, 0) + 0.25 * rng.normal(size=(180, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, []), (None, v[0].tolist()), (504, v[0].tolist()), (505, v[0][:8].tolist())]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect()}
    ids = [*range(180), 504]
    x = np.array([rows[i][1] for i in range(180)] + [v[0].tolist()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert {i: got[i].n_links for i in ids} == {i: int(k) for i, k in zip(ids, link.sum(1), strict=True)}
    label = np.array(ids)
    for _ in range(200):
        label = np.minimum(label, np.where(link, label[None, :], 10**9).min(1))
    assert {i: got[i].component_id for i in ids} == dict(zip(ids, label.tolist(), strict=True))
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 505, None))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_graph_recall():
    v = np.random.default_rng(1).normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(v).build()
    ids, _ = g.search(0, g.v[:200], g.entry(0, g.v[:200])[:, None], 64)
    true = np.argsort(-(g.v[:200] @ g.v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) >= 0.9


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 8):
        runs = [sorted((rng.randrange(9), i) for i in range(rng.randrange(5))) for _ in range(k)]
        assert list(warc.loser_tree_merge(runs)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    rows = [(1, "http://B.example.com:80/x?y#z", "<p>é</p>"), (2, "https://www.a.org", "<p>é</p>"), (3, None, None), (4, "bad\r\nurl", ""), (None, "http://a.org/", "<p>é</p>"), (5, "http://a.org/q", "unique")]
    index, path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.read_warc(index, path).collect()}
    assert len(got) == 6
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    for p, _, html in rows:
        assert got[p].payload_digest == sha(html) and got[p].payload_bytes == len((html or "").encode())
    assert (got[1].record_type, got[2].refers_to, got[4].refers_to, got[None].record_type) == ("response", 1, 3, "revisit")
    order = [(r.urlkey, r.ts) for r in index.orderBy("part", "at").collect()]
    assert order == sorted(order)
    many = spark.createDataFrame([(i, f"http://h{i % 3 // 2}.org/", str(i)) for i in range(50)], "page_id long, url string, html string")
    merged, _ = warc.write_warc(many, range_rows=4)
    seen = merged.orderBy("urlkey", "ts").collect()
    assert merged.select("part").distinct().count() > 4
    assert [r.capture for r in seen] == [*range(1, sum(i % 3 < 2 for i in range(50)) + 1), *range(1, sum(i % 3 == 2 for i in range(50)) + 1)]
    one = index.filter("record_type = 'response'").first()
    with open(re.sub("^file:(//)?", "", path) + "/" + one.archive, "rb") as f:
        f.seek(one.offset)
        assert zlib.decompress(f.read(one.length), 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    index, path = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(index, path).collect() == []


@pytest.mark.parametrize("frequent", [{}, {"sample": 1, "frequent_runs": 3}])
def test_suffix_hot_anchors_come_apart(spark, monkeypatch, frequent):
    # one phrase in all documents, other words around it: its runs are edges, and windows settle alone
    monkeypatch.setattr(suffix, "HOT", 3)
    rng = random.Random(3)
    phrase = "a phrase that stands in every one of these documents, word for word, again and again"
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [(i, word(rng.randrange(60)) + rng.choice(["x", "yy", ""]) + phrase + rng.choice(["z", "uu", ""]) + word(rng.randrange(60))) for i in range(60)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.erase_repeats(spark.createDataFrame(texts, "doc_id long, text string"), **frequent).collect()}
    first: dict = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                hit[k : k + 50] = True
        assert got[i] == (int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()))


def test_few_links_do_not_widen_the_beam(monkeypatch):
    """Where nearest others are mostly far below a link, beams are for links, and links just at the limit are found."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(4000, 96))), unit(rng.normal(size=(4000, 96)))
    away = rng.normal(size=(20, 96))
    away = unit(away - np.einsum("kd,kd->k", away, a[:20])[:, None] * a[:20])
    b[:20] = 0.9001 * a[:20] + np.sqrt(1 - 0.9001**2) * away
    sides = []
    for k, v in enumerate((a, b)):
        blob, sizes = hnsw.Graph(v, 12).build().dump()
        ids = np.arange(4000) + 10_000 * k
        sides.append({"dim": 96, "shard": k, "cids": ids.tobytes(), "rows": np.ones(4000, np.int64).tobytes(), "vectors": v.tobytes(), "graph": blob, "sizes": sizes})
    beams, audit = [], embeddings.audit_beam
    monkeypatch.setattr(embeddings, "audit_beam", lambda *x: beams.append(audit(*x)) or beams[-1])
    out = embeddings.link_shards(pa.Table.from_pylist(sides), 12, 0.9, 48, 256, 0.98).to_pylist()
    assert max(beam for beam, _ in beams) <= 96 and out[-1]["recall"] >= 0.98
    found = {r["cid"]: (r["links"], r["root"]) for r in out[:-1]}
    want = {i + k: (1, i) for i in range(20) for k in (0, 10_000)}
    assert len(found.items() & want.items()) >= 0.98 * len(want) and found.keys() <= want.keys()


def test_shards_of_one_task_get_a_graph_each():
    rng = np.random.default_rng(9)
    rows = [{"dim": d, "shard": s, "cid": i, "rows": 1, "embedding": rng.normal(size=d).tolist()} for i, (d, s) in enumerate([(4, 1)] * 5 + [(4, 7)] * 3 + [(8, 1)] * 4)]
    table = pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("cid", pa.int64()), ("rows", pa.int64()), ("embedding", pa.list_(pa.float64()))]))
    got = [r for x in embeddings.build_shards(table.to_batches(max_chunksize=2), 12) for r in x.to_pylist()]
    assert [(r["dim"], r["shard"], np.frombuffer(r["cids"], np.int64).tolist()) for r in got] == [(4, 1, [0, 1, 2, 3, 4]), (4, 7, [5, 6, 7]), (8, 1, [8, 9, 10, 11])]


def test_large_groups_of_near_vectors_are_counted_exactly(spark):
    # groups wider than the beam, in several shards, beside loose rows
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 12))
    v = np.concatenate([base[0] + 0.05 * rng.normal(size=(150, 12)), base[1] + 0.2 * rng.normal(size=(80, 12)), rng.normal(size=(120, 12))])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(frame, shards=3, beam=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(len(v))] == link.sum(1).tolist()
    label = np.arange(len(v))
    for _ in range(50):
        label = np.minimum(label, np.where(link, label[None, :], 10**9).min(1))
    assert [got[i].component_id for i in range(len(v))] == label.tolist()
    assert 0.98 <= got[0].audited_recall <= 1


def test_audit_widens_the_beam():
    v = np.random.default_rng(2).normal(size=(800, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(v).build()
    beam, share = embeddings.audit_beam(g, g, 1, np.arange(200), True, 0.95)
    assert beam > 1 and share >= 0.95


def test_language_ranks_against_plain_python(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcde fgh", "bb": "cdefg hij", "cc": "éèàça bd"}
    text = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    rows = [(i, text(lang := rng.choice(list(alphabets)), rng.randint(0, 200)), lang if rng.random() < 0.7 else None) for i in range(90)] + [(90, None, "aa"), (91, "12 3!", "bb"), (92, "Ab" * 30_000, None)]
    ranks = 40

    def grams(x):
        codes = langid.letters_of(x) if x is not None else ()
        return [] if len(codes) <= 2 else [int(g) for g in langid.ranked(*langid.ngrams(codes), ranks)]

    counts = {}
    for _, x, lang in rows:
        if x is not None and lang is not None and len(codes := langid.letters_of(x)) > 2:
            g, n = langid.ngrams(codes)
            for a, b in zip(g.tolist(), n.tolist(), strict=True):
                counts.setdefault(lang, {}).setdefault(a, 0)
                counts[lang][a] += b
    profiles = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:ranks])} for lang, c in counts.items()}
    want = {}
    for i, x, _ in rows:
        top = grams(x)
        cost = sorted((sum(abs(p[g] - k) if g in p else ranks for k, g in enumerate(top)), lang) for lang, p in profiles.items())
        want[i] = (cost[0][1], round(1 - cost[0][0] / (len(top) * ranks), 9)) if top else ("und", 0.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs.select("doc_id", "text"), docs.select("text", "lang"), ranks=ranks).collect()}
    assert got == want


def test_shards_keep_every_row_and_the_query_its_digests(spark, tmp_path):
    from pagegrid.llm import queries

    rows = [(i, None if i % 17 == 0 else f"text {i % 40} é" * (i % 9)) for i in range(500)] + [(7, "text 7 é" * 7)] * 30 + [(None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_external_shuffle(spark, str(tmp_path)).collect()
    size = lambda x: len((x or "").encode()) + 8
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((i, size(x), zlib.crc32((x or "").encode())) for i, x in rows), key=str)
    held = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(slots == list(range(len(slots))) for slots in held.values()) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_targets_of_a_mix_are_filled_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 0, None: 500}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    weight = {s: w for s, w in zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in sizes}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    got = mixing.mix_plan(docs).collect()
    assert all(abs(r.target - target[r.source]) < 1e-6 * total for r in got)
    assert all(abs(r.taken - target[r.source]) <= 64 + 1 and r.taken <= 3 * r["size"] for r in got)


def test_near_copies_are_found_at_every_size(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 30, 80, 300]))]
        near = list(words)
        near[rng.randrange(len(near) - 1)] = "changed" if len(words) > 30 else near[0]
        near = near[:-1] if len(words) <= 30 else near
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, near)]
        if 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]):
            pairs.append(2 * i)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 40 and all(got[i] == got[i + 1] == i for i in pairs)
    assert all(got[2 * i + 1] == 2 * i + 1 for i in range(150) if 2 * i not in pairs)
