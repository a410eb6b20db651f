"""Rows to fit on are bounded by ids, so copies of one id neither fill the driver nor weigh more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.llm import language_id, quality_classifier, quality_rules

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Documents, the same with thousands of copies of one labelled id, and labels; ``hot`` is in no held-out fold."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    ids = [row.doc_id for row in marks.where("quality is not null and crc32(cast(doc_id as string)) % 5 <> 0 and crc32(cast(doc_id as string)) % 3 <> 1").orderBy("doc_id").collect()]
    hot = docs.where(F.col("doc_id") == ids[0])
    copies = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("copy")
    return docs, docs.unionByName(copies), marks


def test_classifier(spark, tables):
    docs, more, marks = tables
    options = quality_classifier.FitOptions(n_features=32)
    assert quality_classifier.labelled_statistics(more, marks, options).count() <= marks.count()
    models = [quality_classifier.fit(spark, rows, marks, options) for rows in (docs, more)]
    assert all(np.allclose(getattr(models[0], name), getattr(models[1], name)) for name in ("centre", "scale", "weights"))


def test_rules(spark, tables):
    docs, more, marks = tables
    forests = [quality_rules.fit(spark, rows, marks) for rows in (docs, more)]
    assert forests[0].limit == forests[1].limit


def test_languages(spark, tables):
    docs, more, _ = tables
    options = language_id.TrainOptions(max_documents=50, least_documents=5)
    windows = [language_id.training_windows(rows, options).sort_values(["lang", "bytes"]).values.tolist() for rows in (docs, more)]
    assert windows[0] == windows[1] and len(windows[0]) <= 4 * 120


def test_a_rare_language_is_learned(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 500 = 0, 'xx', 'en') as lang", "concat('text number ', id) as text")
    found = language_id.training_windows(rows, language_id.TrainOptions(max_documents=30, least_documents=5))
    assert set(found["lang"]) == {"xx", "en"}


def test_numerals_are_no_letters(spark):
    """Fractions, powers, circled and Roman numerals: such texts have no language."""
    docs = spark.createDataFrame([(1, "½ ²"), (2, "①Ⅳ 12_"), (3, "ª"), (4, "word")], "doc_id long, text string")
    network = language_id.train(spark.createDataFrame([(at, "en" if at % 2 else "de", f"some words {at}" if at % 2 else f"einige Wörter {at}")
                                                       for at in range(40)], "doc_id long, lang string, text string"), language_id.TrainOptions(epochs=1))
    found = {row.doc_id: row.lang_pred for row in language_id.predicted(docs, network).collect()}
    assert found[1] == found[2] == "und" and found[3] != "und" and found[4] != "und"


def test_rules_are_learned_from_all_labelled_rows(spark):
    """Rows that a sample by a hash of their ids would leave out: they count in the limit as all others do."""
    words = "concat_ws(' ', transform(sequence(1, 40), k -> concat('word', pmod(xxhash64(id, k), 300))))"
    left_out = "pmod(xxhash64(id, 'sample'), 1 << 30) >= 0.95 * (1 << 30)"
    clean = spark.range(24_000).selectExpr("id as doc_id", f"{words} as text", "1 as quality")
    odd = (spark.range(50_000, 60_000).where(left_out).limit(200)
           .selectExpr("id as doc_id", f"concat(upper({words}), ' ! # | 12345') as text", "0 as quality"))
    rows = clean.unionByName(odd)
    forest = quality_rules.fit(spark, rows.drop("quality"), rows.drop("text"))
    found = quality_rules.judged(rows, forest).groupBy("quality").agg(F.avg(F.col("rules.kept").cast("double")).alias("kept")).collect()
    assert {row.quality: row.kept > 0.99 for row in found} == {1: True, 0: False}


def test_rules_equal_those_of_rows_at_hand(spark, tables):
    """Box, leaves and limit from aggregates: the same trees as from all rows in one place."""
    docs, _, marks = tables
    found = quality_rules.fit(spark, docs, marks)
    table = quality_rules.measured(spark, docs).where("not base_failed").join(marks.where("quality is not null"), "doc_id").toPandas()
    values, clean = np.stack(table["stats"]), (table["quality"] > 0).to_numpy()
    forest = quality_rules.grow(values[clean], values, quality_rules.ForestOptions())
    for name in ("roots", "statistic", "split", "child", "path"):
        assert (getattr(found, name) == getattr(forest, name)).all()
    anomaly = found.anomaly(values)
    lost = (anomaly[clean] >= found.limit).mean()
    gain = (anomaly[~clean] >= found.limit).mean() - lost
    assert lost <= 0.005
    for limit in anomaly:
        if (anomaly[clean] >= limit).mean() <= 0.005:
            assert gain >= (anomaly[~clean] >= limit).mean() - (anomaly[clean] >= limit).mean() - 1e-12


def test_paths_by_recursion():
    """Every row goes down each tree by its splits; a branch ends where it holds one of ``subsample`` clean rows, or at full depth."""
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(2000, 3))
    options = quality_rules.ForestOptions(trees=5, subsample=64, max_depth=6)
    forest = quality_rules.grow(clean, clean, options)

    def walk(node, rows, depth):
        held = len(rows) * 64 / 2000
        if forest.child[node] < 0:
            assert held <= 1 or depth == 6
            assert forest.path[node] == depth + quality_rules.average_path(np.rint(held))
            return
        assert held > 1 and depth < 6
        right = rows[:, forest.statistic[node]] >= forest.split[node]
        walk(forest.child[node], rows[~right], depth + 1)
        walk(forest.child[node] + 1, rows[right], depth + 1)

    for root in forest.roots:
        walk(root, clean, 0)
