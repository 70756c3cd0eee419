"""What the pipeline's language stage keeps."""

from llm import brute

from rollweave.llm import language


def test_mixed_texts_are_kept(spark):
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet")
    parts = {}
    for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect():
        parts.setdefault(r.lang, r.text[:300])
    mixed = spark.createDataFrame([(-1, " ".join(parts.values())), (-2, "12 + 34"), (-3, None)], "doc_id long, text string")
    docs = docs.unionByName(mixed, allowMissingColumns=True)
    judged = {r.doc_id: r for r in language.predict(docs).collect()}
    assert judged[-1].score < 0.4 and len(parts) > 2
    kept = {r.doc_id for r in language.accepted(docs).collect()}
    assert kept == {i for i, r in judged.items() if r.lang_pred != "und"} and -1 in kept and not kept & {-2, -3}


def test_all_are_kept_without_labels(spark):
    docs = brute.frame(spark, brute.documents()[:30]).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert language.accepted(docs).count() == 30
