"""The pipeline's stages on small tables, held against the operators' own results."""

import corpus_pipeline
from larkspark.llm.minhash import shingles

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, []
    from larkspark.llm.common import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = cut(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before)
        seen.append((name, len(gone)))
        if name in ("quality classifier", "toxicity"):
            bad = (lambda r: r["quality"] == 0) if name[0] == "q" else (lambda r: r["toxic"] == 1)
            known = [i for i in before if i in labels]
            assert sum((i in gone) == bad(labels[i]) for i in known) / len(known) > 0.95
        elif name == "minhash near-dedup":
            sets = {i: set(shingles(r["text"], 5).tolist()) for i, r in after.items()}
            ids = sorted(i for i in sets if sets[i])
            for n, i in enumerate(ids):
                for j in ids[n + 1 :]:
                    if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                        assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
        else:
            assert not gone and any(before[i]["text"] != after[i]["text"] for i in before)
    assert all(n for _, n in seen[:3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


ODD = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "x" * 100_000, "en", "s", 100_000), (4, "the same words in a text of some length here " * 20, "de", "s", 900), (4, "the same words in a text of some length here " * 20, "de", "s", 900), (None, "no id at all", "en", "s", 12)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, entities string, sequence_id long, id string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names: no stage fails, and only the copy goes where nothing is learnt."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(*r, 0.1, True, "e", 7, "z") for r in ODD], COLUMNS)
    for rows, kept in ((docs, [5, 5, 5]), (docs.filter("false"), [0, 0, 0])):
        out = corpus_pipeline.toxicity_filter(spark, rows, str(tmp_path))
        counts = [out.count()]
        assert out.columns == rows.columns
        once = corpus_pipeline.near_dedup(spark, out, str(tmp_path))
        counts.append(once.count())
        new = corpus_pipeline.pii_surrogates(spark, once, str(tmp_path))
        counts.append(new.count())
        assert once.columns == new.columns == rows.columns
        packed = corpus_pipeline.best_fit_packing(spark, new, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == (5 if kept[0] else 0)
        assert counts == ([6, 5, 5] if kept[0] else kept)
    # Without labels the quality of all is 0, the share of good ones among none: all are rejected, none crash.
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).columns == docs.columns
