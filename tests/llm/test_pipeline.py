from collections import Counter
from pathlib import Path

import corpus_pipeline
from quire.llm import language_id, mixing, staging
from quire.llm.queries import labelled_domains

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_pipeline(spark):
    """Every stage ran, none lost what it should keep, and texts come back from their ids."""
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "source_mixing", "sentencepiece"]
    assert 0 < len(rows) <= len(docs) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_pieces * 4 == len(r.ids) for r in rows)


def test_early_stages_on_odd_rows(spark):
    """Null ids, texts and languages, blanks, digits, equal texts, and columns with clashing names; an empty table stays empty."""
    text = "The quick brown fox jumps over the lazy dog, again and again, until the evening comes."
    rows = [(1, text, "en", "x", 5, "a"), (2, text.upper(), "en", "x", 5, "b"), (3, None, "en", "x", 0, "c"), (4, "", None, None, 0, None), (5, "12 $$ 3", "en", "x", 3, "d")]
    rows += [(6, "Der schnelle braune Fuchs springt über den faulen Hund, immer wieder, bis der Abend kommt.", "de", "x", 9, "e"), (None, text + " No id.", None, "y", 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sid string").selectExpr("*", "'m' as `__repeated_x`", "1 as kept")
    found = STAGES["language_id"](spark, docs, SF)
    assert found.columns == docs.columns
    got = found.collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, 6, None]) and all(r.lang in ("en", "de") for r in got)
    alone = STAGES["exact_dedup"](spark, found, SF)
    assert alone.columns == docs.columns and Counter(r.doc_id for r in alone.collect()) == Counter([2, 6, None])
    for name in ("language_id", "exact_dedup"):
        assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(*names)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = staging.stage(stage(spark, now, str(tmp_path)), name)
        after = [r.doc_id for r in now.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)) or name == "language_id"
        assert now.columns == names or name == "sentencepiece"
    assert now.count() > 10 and language_id.UNKNOWN == "und"
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "source_mixing", "sentencepiece"]


def _staged(spark):
    """Folders that this session has staged and not deleted."""
    folder = Path(staging.shared_dir(spark).removeprefix("file:")) / f"quire-{spark.sparkContext.applicationId}"
    return {p.name for p in folder.glob("*")}


def test_stages_leave_nothing_on_disk(spark, docs):
    before = _staged(spark)
    rows = STAGES["jaccard_join"](spark, docs.select("doc_id", "text"), SF)
    assert [x.split("-")[0] for x in _staged(spark) - before] == ["gone"] and 10 < rows.count() < docs.count()
    before = _staged(spark)
    found = corpus_pipeline.run(spark, SF)
    assert len(_staged(spark) - before) == 1 and found.count() > 10


def test_mixing_shuffles_no_text(spark):
    """The rates are those of mixed(), whatever the ids are, and no join brings them to the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = labelled_domains(spark, SF)
    rates = mixing.mixed(docs, labels, None, keep_totals=corpus_pipeline.KEPT)
    want = {r.doc_id for r in rates.where("rate >= 0.5").collect()}
    kept = STAGES["source_mixing"](spark, docs, SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and 0 < len(want) < docs.count() and kept.columns == docs.columns
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
