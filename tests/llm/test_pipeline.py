"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

import corpus_pipeline
from veiltab.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item = say(30)
    rows, labels = [], []
    for i in range(300):
        t = "\n".join(say(20) for _ in range(4))
        toxic = i % 6 == 0
        if toxic:
            t += "\n" + " ".join(rng.choice(["grumblefool", "snarkwit"]) for _ in range(6))
        rows.append((i, ("Menu home about\n" if i % 3 == 0 else "") + t, "en", f"s{i % 2}", len(t)))
        labels.append((i, 0, int(toxic)))
    rows += [(1000 + k, rows[1][1], "en", "s9", 1) for k in range(5)]
    rows += [(2000, f"{say(20)} {item} {say(20)}", "en", "s9", 1), (2001, None, "en", "s9", 0), (2002, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, d = dict(corpus_pipeline.STAGES), str(tmp_path)
    ids = lambda df: {r.doc_id for r in df.collect()}
    kept = stages["toxicity"](spark, docs, d)
    toxic = {i for i, _, t in labels if t}
    assert kept.columns == docs.columns and ids(docs) - ids(kept) == toxic
    lines = stages["line_dedup"](spark, docs, d)
    assert lines.columns == docs.columns and lines.count() == docs.count() and not any("Menu" in (r.text or "") for r in lines.collect())
    single = stages["near_dedup"](spark, docs, d)
    assert single.columns == docs.columns and ids(docs) - ids(single) == {1000 + k for k in range(5)}
    clean = stages["decontamination"](spark, docs, d)
    assert clean.columns == docs.columns and ids(docs) - ids(clean) == {2000}
    out = corpus_pipeline.run(spark, d)
    assert ids(out) == ids(docs) - toxic - {1000 + k for k in range(5)} - {2000}
    empty = spark.createDataFrame([], schema)
    assert all(f(spark, empty, d).count() == 0 for f in stages.values())
    assert "op3_packing" in queries.QUERIES
