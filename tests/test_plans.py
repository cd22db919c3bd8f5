"""Records of documents hold their whole texts."""

from __future__ import annotations

from linkwright.queries import plans


def test_document_records_hold_every_word(spark, tmp_path):
    opening = " ".join(f"w{i}" for i in range(20))
    texts = {4: opening + " one end", 5: opening + " another end", 6: "short text", 7: None}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.rid: f"{r.name} {r.address}".split() for r in plans.document_records(spark, str(tmp_path)).collect()}
    assert found == {i: (t or "").split() for i, t in texts.items()}


def test_fold_scores_read_stored_rows(spark, sf):
    """The windows behind the features aren't computed again for every fit and every scoring."""
    found = plans.oof_scores(spark, sf)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    rows = plans._model_rows(spark, sf)
    assert found.count() == rows.count() and found.columns == ["q", "p", "y", "fold", "prob"]
