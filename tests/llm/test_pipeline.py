"""The pipeline: planted rows go, clean rows stay, and each stage's columns."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    syl = {"en": ["th", "in", "er", "on", "an", "re", "st"], "de": ["sch", "ung", "ein", "keit", "ü", "ber"]}
    words = lambda lang, n: ["".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    bench = {i: " ".join(words("en", 25)) for i in range(5)}
    docs, labels, want = [], [], set()
    for d in range(600):
        lang = "de" if d % 4 == 0 else "en"
        w, toxic = words(lang, rng.randint(40, 160)), d % 5 == 0
        if toxic:
            w[3:3] = ["moron", "idiotic", "scumbag"]
        docs.append((d, " ".join(w), lang, "s", 0))
        labels.append((d, 1, int(toxic)))
        if not toxic:
            want.add(d)
    clean = [d for d in docs if d[0] in want and len(d[1].split()) >= 100]  # one changed word leaves a similarity of 0.9
    for k in range(40):
        t = clean[k][1].split()
        t[rng.randrange(len(t))] = "changed"
        docs.append((1000 + k, " ".join(t), "en", "s", 0))
    for k in range(10):
        docs.append((2000 + k, " ".join(words("en", 40)) + " " + bench[k % 5] + " " + " ".join(words("en", 40)), "en", "s", 0))
    docs += [(3000, None, None, "s", 0), (3001, "1 2 3", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == columns
        path = f"{tmp_path}/{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in now.select("doc_id").distinct().collect()}
    everything = {d[0] for d in docs}
    assert everything - kept["language"] == {3000, 3001}
    assert {d for d in range(600) if d not in want} & kept["toxicity"] == set() and len(want & kept["toxicity"]) >= 0.98 * len(want)
    assert not any(1000 + k in kept["near-copies"] for k in range(40))
    assert len(want & kept["near-copies"]) >= len(want & kept["toxicity"]) - 1
    assert not any(d >= 2000 for d in kept["decontamination"]) and len(kept["decontamination"]) >= 0.97 * len(want)
    assert kept["packing"] == kept["decontamination"]
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, equal rows, an extra column with a name the operators use, and empty tables."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice(["th", "in", "er", "on"]) for _ in range(3)) for _ in range(n))
    item, first, second, third = (text(n) for n in (30, 60, 70, 80))
    rows = [(1, first), (1, second), (1, first), (2, first), (None, first), (None, third), (None, third), (3, text(20) + " " + item), (None, text(25) + " " + item), (3, text(90)), (4, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], schema)
    where = str(tmp_path)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, where)
        now.write.parquet(f"{where}/{name}")
        now = spark.read.parquet(f"{where}/{name}")
        assert now.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in now.collect()), key=key) == sorted([(1, first), (1, second), (None, third), (3, rows[9][1])], key=key)
    assert corpus_pipeline.run(spark, where).select("doc_id").distinct().count() == 3
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{where}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
