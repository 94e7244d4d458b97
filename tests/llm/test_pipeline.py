"""The pipeline's stages take effect one after another."""

import re
from collections import Counter

import corpus_pipeline
from hornfels.llm.common import persist

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mix", "pack"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = persist(stage(spark, docs, SF))
        if name != "pack":
            assert out.columns == docs.columns
        seen[name], docs = (docs, out), out
    kept = {n: (a.count(), b.count()) for n, (a, b) in seen.items()}
    assert kept["quality"][1] < kept["quality"][0] and kept["near"][1] <= kept["near"][0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r.doc_id for r in seen["quality"][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in stay for i in good) >= 0.97 * len(good)
    lines = Counter(x for r in seen["lines"][1].collect() for x in set(r.text.split("\n")) if len(re.findall(r"\S+", x)) >= 8)
    assert not [x for x, n in lines.items() if n > 1]
    taken = Counter(r.doc_id for r in seen["mix"][1].collect())
    assert set(taken) <= {r.doc_id for r in seen["near"][1].collect()} and max(taken.values()) <= 2
    packed = seen["pack"][1].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken
    sums = Counter()
    for r in packed:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 4096


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, equal ids and clashing columns; then no rows at all."""
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", "a"), (2, "", "b"), (3, None, None), (5, long, "b"), (5, long, "b"), (None, "a text without an id", "c"), (7, "the same old text", "a"), (8, "the same old text", None), (9, "alpha beta gamma delta epsilon zeta eta theta", "a"), (9, "another text of nine", "a")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, size long, taken long, piece int, kept boolean, score double, _x binary, n_lines int, gone long"
    docs = spark.createDataFrame([(i, t, s, "en", len(t or ""), 1, 2, 3, True, 0.5, None, 4, 5) for i, t, s in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")  # of one class: nothing is rejected
    for name, own in (("all", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        own.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES:
            now = persist(f(spark, now, folder))
            seen[stage] = now
            assert stage == "pack" or now.columns == docs.columns
        if name == "none":
            assert all(df.count() == 0 for df in seen.values())
            continue
        ids = {stage: Counter(r.doc_id for r in df.select("doc_id").collect()) for stage, df in seen.items()}
        assert ids["quality"] == Counter(i for i, _, _ in rows)
        assert ids["lines"] == ids["quality"] - Counter([9])  # all of its one line is in document 1
        assert ids["near"] == ids["lines"] - Counter([8])
        assert set(ids["mix"]) <= {1, 5, 7, 9, None} and max(Counter(ids["mix"]).values()) <= 4
        assert ids["pack"].keys() == ids["mix"].keys()
