from tests.llm.fixtures import deduped, near_groups


def test_stages_against_plain_python(spark, tmp_path):
    """Each stage on its own input; the deduplicating ones against brute force."""
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            continue
        assert docs.columns == columns
        was, now = ({r.doc_id: r for r in x.collect()} for x in (before, docs))
        assert set(now) <= set(was)
        if name == "line dedup":
            want = dict(deduped([(i, r.text) for i, r in was.items()]))
            assert {i: r.text for i, r in now.items()} == {i: t for i, t in want.items() if t.strip() or not was[i].text.strip()}
            assert all(r.n_chars == len(r.text) for i, r in now.items() if r.text != was[i].text)
        elif name == "near duplicates":
            assert set(now) == {i for i, c, _ in near_groups([(i, r.text) for i, r in was.items()]) if i == c}
            assert all(now[i] == was[i] for i in now)
        else:
            assert 0.6 * len(was) < len(now) < len(was) and all(now[i] == was[i] for i in now)


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline as pipeline

    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "bin", "position"] and out.count() > 100


def test_near_duplicates_of_repeated_rows(spark):
    import corpus_pipeline as pipeline
    from tests.llm.fixtures import documents, frame

    rows = documents()
    got = pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    want = {i for i, c, _ in near_groups(rows) if i == c}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 2


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    import random

    import corpus_pipeline as pipeline
    from tests.llm.fixtures import frame, words

    rng = random.Random(3)
    texts = [" ".join(words(rng, 60)) for _ in range(6)]
    near = texts[0] + " more"
    rows = [(1, texts[0]), (7, near), (7, texts[1]), (7, texts[2]), (7, texts[2]), (7, None), (8, texts[3]), (8, texts[1]), (9, texts[4])]
    rows += [(5, texts[5]), (5, texts[5] + " more"), (None, texts[0])]
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, frame(spark, rows), "").collect()), key=str)
    want = [(1, texts[0]), (7, texts[1]), (7, texts[2]), (7, None), (8, texts[3]), (9, texts[4]), (None, texts[0])]
    five = [r for r in got if r[0] == 5]
    assert len(five) == 1 and five[0] in rows
    assert sorted([*want, *five], key=str) == got


def test_filters_of_awkward_rows(spark, tmp_path):
    """Columns of any name pass, repeated rows fare alike, empty tables stay empty, and without labels nothing is rejected."""
    import corpus_pipeline as pipeline
    from tests.llm.fixtures import documents, frame

    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, (i, _) in enumerate(documents())], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "some" / "labels.parquet"))
    labels.where("false").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    docs = frame(spark, documents(), True).selectExpr("*", "1 as quality", "2 as TOXICITY", "3 as n_lines", "4 as c0", "5 as num")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path / "some"))
        assert out.columns == docs.columns, name
        got = [r.doc_id for r in out.collect()]
        assert set(got) <= {i for i, _ in documents()}
        assert stage(spark, docs.where("false"), str(tmp_path / "some")).count() == 0
    for _, stage in pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path / "none")).count() == len(documents())


def test_line_dedup_of_repeated_rows(spark):
    import corpus_pipeline as pipeline
    from tests.llm.fixtures import deduped, documents, frame

    rows = documents()
    got = pipeline.line_dedup(spark, frame(spark, rows), "").collect()
    blank = [(i, t) for i, t in rows if not (t or "").strip()]
    want = [(i, t) for i, t in deduped(rows) if (t or "").strip() or (i, t) in blank]  # documents that lose every line go
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_run_over_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tests.llm.fixtures import documents, frame

    frame(spark, documents()).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
