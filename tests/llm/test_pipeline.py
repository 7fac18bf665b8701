"""The pipeline stage by stage against brute force on the smallest tables."""

import os
import random
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import decontamination, toxicity  # noqa: E402
from tessera.llm._common import materialise  # noqa: E402

from . import brute  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]

    before = texts(docs)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).select("row.doc_id", "score").collect()}
    docs = materialise(stages["toxicity"](spark, docs, FOLDER), "t")
    assert docs.columns == columns and texts(docs) == {i: t for i, t in before.items() if scores[i] < 0.3}

    before = texts(docs)
    docs = materialise(stages["line_dedup"](spark, docs, FOLDER), "t")
    after = texts(docs)
    assert docs.columns == columns and {i: brute.sha(t) for i, t in after.items()} == {r[0]: r[3] for r in brute.line_dedup(list(before.items()))}

    docs = materialise(stages["ngram_jaccard"](spark, docs, FOLDER), "t")
    assert docs.columns == columns and texts(docs) == {i: after[i] for i, (_, c) in brute.components(list(after.items())).items() if i == c}

    before = texts(docs)
    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = materialise(stages["decontamination"](spark, docs, FOLDER), "t")
    kept = texts(docs)
    assert docs.columns == columns and set(kept) <= set(before)
    whole = lambda t: any(x in decontamination.normalised(t) for x in items)
    assert not any(map(whole, kept.values()))

    out = {r.doc_id: r for r in stages["byte_bpe"](spark, docs, FOLDER).collect()}
    assert {i: brute.sha(t) for i, t in kept.items()} == {i: r.decoded_sha256 for i, r in out.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(kept)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empties, repeats, ties, clashing names; and the folder is clean but for the last stage's input."""
    rng = random.Random(1)
    sentence = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, line = sentence(20), "boiler plate " * 5
    texts = [None, "", " \n", sentence(40), f"{line}\n{sentence(30)}", sentence(12) + " " + item.upper() + " end"]
    rows = [(i, t if i < 6 else f"{line}\n{sentence(30)}" if i < 12 else sentence(50)) for i, t in enumerate(texts + [""] * 30)]
    rows += [(3, texts[3]), (3, texts[3]), (None, None), (None, sentence(25)), (50, texts[3] + " more"), (51, "long " * 50_000), (52, "vile nasty rotten " * 3)]
    toxic = [(i, f"{sentence(12)} vile nasty rotten vile nasty {sentence(12)}" if i % 2 else sentence(30)) for i in range(100, 300)]
    columns = "doc_id long, text string, row string, id string, chunk int, key string, n_chars long"
    docs = spark.createDataFrame([(*r, "r", "i", 1, "k", None) for r in rows + toxic], columns)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in toxic] + [(3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = {i for i, _ in toxic if zlib.crc32(str(i).encode()) % 4 == 2}
    assert held and set(held) < {i for i, _ in toxic}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), "t")
        assert docs.columns == [c.split()[0] for c in columns.split(", ")], name
    clean = {i: t for i, t in rows + [x for x in toxic if x[0] % 2 == 0] if i not in (5, 50, 52)}
    got = docs.select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([*(str(i) for i in clean if i is not None), "None", "None"])
    assert sum(line.strip() in (r.text or "") for r in got) == 1
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in got)
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), folder).count() == 0
