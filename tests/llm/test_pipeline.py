"""The pipeline's stages, each held against its operator on what the stage before kept."""

import corpus_pipeline as C
from lexitally.llm import jaccard, langid, rff
from lexitally.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    outs = [docs]
    for name, stage in C.STAGES:
        outs.append(C.written(stage(spark, outs[-1], SF), f"test-{name}"))
        if name != "best_fit_packing":
            assert outs[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in o.select("doc_id").collect()} for o in outs]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    # each decision is the operator's own on the stage's input
    assert ids[1] == {r["doc_id"] for r in langid.query(spark, outs[0]).where("accepted").collect()}
    labels = table(spark, SF, "labels")
    assert ids[2] == {r["doc_id"] for r in rff.query(spark, outs[1], labels).where("predicted = 1").collect()}
    assert ids[3] == {r["doc_id"] for r in jaccard.query(spark, outs[2]).where("doc_id = component_id").collect()}
    # clean documents stay: of those labelled good, only copies go
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len((ids[0] - ids[2]) & good) <= 0.02 * len(good)


def test_run_packs_what_is_left(spark):
    got = C.run(spark, SF).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert got and max(fill.values()) <= 2048


def test_empty_and_null_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    """Columns that share a name with an operator's own pass through the filtering stages."""
    from pyspark.sql import functions as F
    extra = ["uid", "spans", "kept", "removed", "n_bytes", "lang_pred", "score", "accepted", "cls", "comp", "key",
             "stats", "predicted", "component_id", "a.b"]
    docs = table(spark, SF, "documents").where("doc_id < 60")
    for i, c in enumerate(extra):
        docs = docs.withColumn(c, F.lit(f"{c}{i}"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{i}" for r in rows for i, c in enumerate(extra)), name
    assert C.STAGES[-1][1](spark, docs, SF).count() >= 60


def test_tasks_give_back_memory_after_their_tables_are_freed(monkeypatch):
    """Workers live on beside the JVM: what a task's tables held goes back to the system."""
    from lexitally.llm import common
    events = []

    class Table:
        def __del__(self):
            events.append("freed")

    class Libc:
        def malloc_trim(self, pad):
            events.append("trimmed")

    def scan(batches):
        table = Table()
        for batch in batches:
            yield batch, id(table) != 0

    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: Libc())
    assert list(common.frugal(scan)([1, 2])) == [(1, True), (2, True)]
    assert events == ["freed", "trimmed"]


def test_release_frees_the_drivers_python_first():
    """Python's objects hold the JVM's plans and broadcasts: cycles go before the JVM's collector runs."""
    import gc
    from types import SimpleNamespace as N
    from lexitally.llm import common
    events = []

    class Frame:
        def __del__(self):
            events.append("freed")

    system = N(gc=lambda: events.append("jvm"))
    spark = N(sparkContext=N(_jvm=N(System=system)))
    gc.disable()
    try:
        frame = Frame()
        frame.own = frame
        del frame
        common.release(spark)
    finally:
        gc.enable()
    assert events == ["freed", "jvm"]
