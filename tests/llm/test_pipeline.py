"""Each stage of the corpus pipeline against plain Python on awkward rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pagegrid.llm import mixing, packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, rank string, label string, rk string"
EN = "the people of this small town have always known that the river would come back one day and take the old bridge"
FR = "les gens de cette petite ville ont toujours su que la rivi\u00e8re reviendrait un jour et prendrait le vieux pont"
LINE = "This Line Is In Three Documents"
ROWS = [
    (1, EN, "en", "a", 1, "x", "r", "l", "k"), (2, EN + " again", None, "a", 1, "x", "r", "l", "k"), (3, FR, "fr", "b", 1, None, None, None, None),
    (4, FR + " encore", None, "b", 1, None, None, None, None), (5, None, "en", "a", None, None, None, None, None), (6, "", None, None, 0, None, None, None, None),
    (7, "12 34 \n", "en", "a", 1, None, None, None, None), (None, EN + " and more", "en", None, 1, None, None, None, None),
    (8, LINE + "\none side of the story", "en", "c", 1, None, None, None, None), (9, "  " + LINE.upper() + "\t\nanother side of it", "en", "c", 1, None, None, None, None),
    (10, LINE.lower() + "\nthe third and last side", "en", None, 1, None, None, None, None), (10, LINE.lower() + "\nthe third and last side", "en", None, 1, None, None, None, None),
    (11, " ".join(f"w{i % 97} of{i % 89}" for i in range(40_000)), "en", "d", 1, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), "")
    assert out.collect() == [] and (name == "length_packing" or out.columns == [c.split()[0] for c in SCHEMA.split(", ")])


def test_language_id(spark, docs):
    got = rows(corpus_pipeline.language_id(spark, docs, ""))
    guess = {2: "en", 4: "fr"}
    assert got == sorted(((r[0], r[1], r[2] or guess[r[0]], *r[3:]) for r in ROWS if r[0] not in (5, 6, 7)), key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_other_columns_keep_their_names_and_values(spark, docs, name, stage):
    from pyspark.sql import functions as F

    names = ["_id", "score", "lang_pred", "kept_text", "n_lines", "n_dropped", "a.b", "id", "gone", "kept", "center", "component_id", "back`tick"]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain.select("*", *[F.lit(f"my {c}").alias(c) for c in names])
    got = stage(spark, wide, "")
    assert got.columns == wide.columns and got.count() > 0
    assert {tuple(r)[5:] for r in got.collect()} == {tuple(f"my {c}" for c in names)}
    if name != "source_mix":  # a row's digest orders the mix
        assert rows(got.select("doc_id", "text", "lang", "source", "n_chars")) == rows(stage(spark, plain, ""))


def test_line_dedup(spark, docs):
    got = rows(corpus_pipeline.line_dedup(spark, docs, ""))
    gone = {8: "one side of the story", 9: "another side of it"}
    want = [(r[0], t := gone.get(r[0], r[1]), *r[2:4], None if t is None else len(t), *r[5:]) for r in ROWS]
    assert got == sorted(want, key=str)


def test_near_dedup(spark, docs):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = rows(corpus_pipeline.near_dedup(spark, docs, ""))
    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    assert least[2] == 1 and least[4] == 3
    assert got == sorted((r for r in ROWS if r[0] is None or least[r[0]] == r[0]), key=str)


def test_source_mix(spark, docs):
    got = corpus_pipeline.source_mix(spark, docs, "").collect()
    plan = {}
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.taken
    took = {}
    for r in got:
        took[r.doc_id, r.source] = took.get((r.doc_id, r.source), 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
        origin = next(x for x in ROWS if x[0] == r.doc_id and x[3] == r.source)
        assert set(r.text.split()) <= set(origin[1].split()) and tuple(r)[5:] == origin[5:]
    assert took == {k: v for k, v in plan.items() if v}


def test_length_packing(spark, docs):
    got = corpus_pipeline.length_packing(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted((str(r[0]), len((r[1] or "").split())) for r in ROWS)
    lengths = sorted({r.length for r in got})
    hist = [(n, [r.length for r in got].count(n)) for n in lengths]
    bounds = packing.choose_buckets(__import__("numpy").array([(c, c * n, n) for n, c in hist]), 12)
    batches = {}
    for r in got:
        assert r.padded_length == min(b for b in bounds if b >= r.length) and r.padding == r.padded_length - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0].padded_length <= 16_384)


def test_run(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    key = lambda r: (str(r.doc_id), r.length)
    assert sorted(map(key, frame.collect())) == sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect()))
