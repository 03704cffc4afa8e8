import corpus_pipeline
from tests.llm.test_decontaminate import expected
from tests.llm.test_neardup import classes

STAGES = dict(corpus_pipeline.STAGES)
FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark, small):
    assert list(STAGES) == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    docs = small["documents"]
    kept = STAGES["language"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    unique = STAGES["near_dedup"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in unique.collect()) == [i for i, c in classes(rows) if i == c]
    clean = STAGES["decontaminate"](spark, docs, FOLDER)
    items = [(r.item_id, r.text) for r in small["benchmark"].collect()]
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, _, hit, _ in expected(rows, items) if not hit]
    mixed = STAGES["mix"](spark, docs, FOLDER)
    assert mixed.columns == docs.columns and 0.7 * docs.count() < mixed.count() < docs.count()
    toxic = {r.doc_id for r in small["labels"].where("toxic = 1").collect()}
    fine = {r.doc_id for r in small["labels"].where("toxic = 0").collect()}
    stay = {r.doc_id for r in mixed.collect()}
    assert len(fine & stay) >= 0.97 * len(fine) and len(toxic & stay) <= 0.5 * len(toxic)
    sharded = STAGES["shard"](spark, docs, FOLDER)
    assert sharded.count() == docs.count() and {"doc_id", "text", "shard", "slot"} <= set(sharded.columns)


def test_whole_run(spark, small):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len(out) < small["documents"].count() and len({r.doc_id for r in out}) == len(out)
    counts = [sum(r.shard == k for r in out) for k in range(24)]
    assert max(counts) - min(counts) <= 1


def test_edges(spark, documents, small, tables):
    text = small["documents"].first().text
    rows = [(1, None, "en"), (2, "", "en"), (3, text, "en"), (3, text, "en"), (4, text, None), (None, "some other words of a text", "en"), (5, "words " * 50_000, "en")]
    folder = tables(benchmark=small["benchmark"], labels=small["labels"])
    docs = documents(rows)
    for name, stage in STAGES.items():
        out = stage(spark, docs, folder)
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert out.count() <= len(rows)
        assert stage(spark, documents([]), folder).count() == 0, name
    kept = STAGES["near_dedup"](spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "5", "None"]
