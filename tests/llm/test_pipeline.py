"""The stages against plain versions of them, each judged on its own input."""

import corpus_pipeline
from arborsim.llm import curriculum, quality
from tests.llm.test_operators import brute_groups, brute_hits, counted, texts, weighed


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "distinct", "decontaminate", "mix", "shard"]

    kept = steps["quality"](spark, docs, sf)
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in texts(docs) if model.score([t.encode()])[0] >= 0.5)

    rows = texts(kept)
    one = steps["distinct"](spark, kept, sf)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute_groups(rows)})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = steps["decontaminate"](spark, one, sf)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(h[0] for h in brute_hits(texts(one), items) if not h[-1])

    mixed = steps["mix"](spark, clean, sf)
    assert mixed.columns == docs.columns
    want = curriculum.mix(weighed(clean)).toPandas().set_index("doc_id")["copies"]
    got = mixed.toPandas().groupby("doc_id").size()
    assert (got.reindex(want.index).fillna(0) == want).all()

    sharded = steps["shard"](spark, mixed, sf)
    assert counted(map(tuple, sharded.select(docs.columns).collect())) == counted(map(tuple, mixed.collect()))
    cut = sharded.toPandas()
    assert len(cut) == want.sum() and cut.groupby("shard").size().agg(lambda s: s.max() - s.min()) <= 1


def test_distinct_links_at_five_words_and_80_percent(spark, sf):
    near = []
    for k, (n, every) in enumerate(((49, 49), (480, 48), (1000, 48), (49, 12), (480, 20))):  # the last two are too far apart
        words = [f"w{k}x{i}" for i in range(n)]
        near += [(10 * k, " ".join(words)), (10 * k + 1, " ".join("new" if i % every == every // 2 else w for i, w in enumerate(words)))]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, sf).collect())
    assert got == sorted({c for _, _, c in brute_groups(near, 5, 80)}) == [0, 10, 20, 30, 31, 40, 41]


def test_distinct_keeps_one_row_of_repeated_ones(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, "x"), (1, a, "w"), (1, a, "x"), (2, a, "x"), (3, b, "x"), (3, a, "x"), (3, b, None), (None, b, "x"), (None, "lost words", "x"), (None, "lost words", "x"), (4, "", "x"), (4, "", "x"), (5, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    one = corpus_pipeline.keep_distinct(spark, docs, sf)
    assert one.columns == docs.columns
    want = [(1, a, "w"), (3, b, None), (None, "lost words", "x"), (4, "", "x"), (4, "", "x"), (5, "alone", "x")]
    assert sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, want))


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_odd_rows_through_every_stage(spark, sf):
    """Null and repeated ids, null and empty texts, a very long one, names that the stages use themselves."""
    said = " ".join(f"plain{i} word" for i in range(40))
    rows = [(None, said, None), (None, None, "a"), (1, said, "a"), (1, said, "a"), (2, "", "a"), (3, None, None), (4, " ".join(f"w{i}" for i in range(20_000)), "b"), (5, "a few words only", "b")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3.0) for r in rows], "doc_id long, text string, source string, shard int, _time string, _kept int, quality_score string, _at double").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        own = got.select(docs.columns).collect()
        assert got.columns[: len(docs.columns)] == docs.columns and set(map(tuple, own)) <= set(map(tuple, docs.collect()))
        assert len(got.columns) == len(docs.columns) + 2 * (name == "shard")
        if name == "distinct":
            assert counted(map(tuple, own)) == counted(map(tuple, [r for r in docs.collect() if r.doc_id != 1 and (r.doc_id, r.text) != (None, said)] + [r for r in docs.collect() if r.doc_id == 1][:1]))
        if name == "decontaminate":
            assert len(own) == len(rows)
        if name == "shard":
            assert len(own) == len(rows)
