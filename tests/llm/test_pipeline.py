import corpus_pipeline
import numpy as np
import sentencepiece
from driftwell.llm import common, mixing, pieces, quality
from tests.llm.helpers import documents, folder
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import brute as rounds
from tests.llm.test_pii import TEXT, plain
from tests.llm.test_quality import corpus


def test_stages(spark, tmp_path):
    rows, marks = corpus()
    rows = [(i, f"{t} {TEXT}" if i == 1 else t, "en", f"src{i % 4}") for i, t in rows]
    rows += [(2000 + i, t, "en", s) for i, t, _, s in rows if i % 5 == 1]  # copies
    docs = documents(spark, rows)
    sf = folder(tmp_path, documents=docs, labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    by_id = {r[0]: r for r in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        kept = {r.doc_id: r for r in out.collect()}
        if i < 4:
            assert out.columns == docs.columns
        if i == 0:
            good = {r.doc_id for r in quality.scored(now, quality.learn(now, spark.read.parquet(f"{sf}/labels.parquet")), ["doc_id"]).filter("quality_score >= 0.3").collect()}
            assert set(kept) == good and len(good) < len(rows)
            assert all(i2 % 2000 in kept or marks[i2 % 2000][1] == 0 for i2 in by_id)
        if i == 1:
            assert set(kept) == {i2 for i2 in good if i2 < 2000}  # each copy's original has the lesser id
        if i == 2:
            assert "[EMAIL]" in kept[1].text and "@" not in kept[1].text
        if i == 4:
            machine = pieces.Transducer(pieces.load())
            assert all(r.round_trip and machine.decode(np.array(r.ids)) for r in kept.values())
        now = out.cache()
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert final == {r.doc_id: r.n_tokens for r in now.collect()}


def test_documents_without_an_id_stay(spark, tmp_path):
    docs = documents(spark, [(None, "a b c d e f g"), (None, "h i j k l m n"), (1, "o p q r s t u"), (2, "o p q r s t u")])
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text[0] for r in kept) == ["a", "h", "o"] and {r.doc_id for r in kept} == {None, 1}


def test_stages_against_second_implementations(spark, tmp_path):
    """Near duplicates by all pairs, base spans by the patterns, the mix by rounds, ids by the library."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(900)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, f"{t} w{i}") for i, t in enumerate(base[:9])] + [(200, base[3]), (300, None), (301, ""), (302, TEXT), (7, base[20]), (7, base[7])]
    docs = documents(spark, [(i, t, "en", f"src{i % 3}") for i, t in rows])
    linked = brute(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    kept = sorted((r.doc_id, r.text or "") for r in out.collect())
    least = {(i, c) for i, c, _ in linked if i == c}
    assert sorted({i for i, _ in kept}) == sorted({i for i, _ in least})
    assert sorted(t for i, t in kept if i == 7) == sorted((base[7], base[20]))  # two texts of one id, each the least of its copies
    clean = corpus_pipeline.personal_data(spark, out, str(tmp_path))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[300] is None and texts[0] == base[0] and not plain(texts[302]) and "[PHONE]" in texts[302]
    drawn = corpus_pipeline.source_mix(spark, clean, str(tmp_path))
    given = [(r.doc_id, r.text, r.lang, r.source) for r in clean.collect()]
    want = rounds(given, mixing.Plan(epochs=1))
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(i for i, copies in want.items() for n in copies for _ in range(n))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {r.doc_id: r.ids for r in corpus_pipeline.token_ids(spark, drawn, str(tmp_path)).collect()}
    assert ids == {r.doc_id: library.encode(r.text or "") for r in drawn.collect()}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (5, "h i j k l m n"), (6, "o p q r s t u"), (6, "v w x y z a b"), (8, None), (8, "")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), str(tmp_path)).collect()
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in kept) == [(1, "a"), (5, "h"), (6, "o"), (6, "v"), (8, ""), (8, "")]


def test_no_documents_and_no_labels(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, None), (2, ""), (3, "one two")])
    assert corpus_pipeline.run(spark, folder(tmp_path / "a", documents=docs.limit(0), labels=none)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder(tmp_path / "b", documents=docs, labels=none)).collect()} <= {1, 2, 3}


def test_finely_cut_documents_are_written_as_few_files(spark, tmp_path, monkeypatch):
    rows, marks = corpus()
    sf = folder(tmp_path, documents=documents(spark, rows).repartition(40), labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    key, cores = "spark.sql.files.maxPartitionBytes", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4k")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        given = docs.rdd.getNumPartitions()
        assert given >= 40 > cores
        for stage in (corpus_pipeline.quality_filter, corpus_pipeline.personal_data, corpus_pipeline.token_ids):
            out = stage(spark, docs, sf)
            assert out.rdd.getNumPartitions() == cores
        kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, sf).collect()}
        assert kept == {r.doc_id for r in quality.scored(docs, quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet")), ["doc_id"]).filter("quality_score >= 0.3").collect()}
        assert int(spark.conf.get("parquet.block.size")) <= common.GROUP_BYTES
        monkeypatch.setattr(common, "TASK_BYTES", 1)
        assert common.merged(docs).rdd.getNumPartitions() == given  # tables of many bytes keep their tasks
    finally:
        spark.conf.set(key, before)
    assert common.merged(documents(spark, rows).repartition(40)).count() == len(rows)
