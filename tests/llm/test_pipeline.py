from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from replicalens.llm import common, jaccard, mixing, pieces, pii, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage's decisions, made again on the driver from the operators' own findings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = list(docs.columns)
    frame = lambda t: spark.createDataFrame(t[names])
    model = quality.fit(frame(docs), labels.where(~quality.held_out(F.col("doc_id"))))
    import pyarrow as pa

    docs = docs[model.score(quality.statistics(pa.array(docs["text"]))) >= 0.5]
    groups = {r.doc_id: r.component_id for r in jaccard.components_of(frame(docs)).collect()}
    docs = docs[[groups[i] == i for i in docs["doc_id"]]]
    docs = docs.assign(text=[pii.mask(t, pii.base_spans(t)) for t in docs["text"]])
    copies = {r.doc.doc_id: r.copies for r in mixing.mix(frame(docs)).collect()}
    want = Counter()
    v = pieces.vocabulary(pieces.MODEL)
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids, _, _ = pieces.encode_block([t], __import__("numpy").array([i]), v)
        want[i, tuple(ids.tolist())] += copies[i]
    got = Counter((r.doc_id, tuple(r.pieces)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_stages_survive_odd_documents(spark, odd_docs, no_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs.select(*columns), no_docs):
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.stage(stage(spark, docs, str(tmp_path)), common.new_folder(spark, "t"))
            assert n == 4 or docs.columns == columns, name
