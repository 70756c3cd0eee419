"""The pipeline's stages, each on what the one before it kept."""

from llm import brute

import corpus_pipeline
from rollweave.llm.common import saved, table


def test_stages(spark):
    docs = table(spark, brute.FOLDER, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, brute.FOLDER), name)
        kept[name] = {r.doc_id for r in after.select("doc_id").distinct().collect()}
        if name != names[-1]:
            assert after.columns == docs.columns
            before, docs = [(r.doc_id, r.text) for r in docs.collect()], after
            texts = {r.doc_id: r.text for r in after.collect()}
            if name == "near_duplicates":
                want = brute.near_components(before, 5, 80)
                assert kept[name] == {i for i, (_, c) in want.items() if i == c}
            if name == "substring_dedup":
                want = brute.word_repeats(before, 20)
                assert {i: " ".join(brute.words(t)) for i, t in texts.items()} == {i: w[2] for i, w in want.items()}
            if name == "decontamination":
                items = [(r.item_id, r.text) for r in table(spark, brute.FOLDER, "benchmark").collect()]
                assert kept[name] == {i for i, _ in before} - {i for i, _ in brute.item_matches(before, items)}
    assert kept["best_fit_packing"] == kept["decontamination"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, brute.FOLDER, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
