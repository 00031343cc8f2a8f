import zlib

import corpus_pipeline
from postlake.llm import bpe, decontamination, secrets, toxicity
from postlake.llm.common import fresh_path
from postlake.llm.shingles import shingle_set
from tests.llm.test_neardup import brute

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_python(spark):
    """run() over a small table, against each rule applied to all rows in memory."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    learnt = [r for r in sorted(rows) if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    model = toxicity.fit([r.text for r in learnt], [labels[r.doc_id] for r in learnt])
    left = [r for r, s in zip(rows, model.scores([r.text for r in rows]), strict=True) if s < 0.5]
    keep = {w[0] for w in brute([(r.doc_id, r.text) for r in left], 5, (4, 5)) if w[0] == w[2]}
    left = [r for r in left if str(r.doc_id) in keep]
    items = [s for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (s := shingle_set(r.text, 5))]
    left = [r for r in left if not any(5 * len(i & shingle_set(r.text, 5)) >= 4 * len(i) for i in items)]
    path = bpe.public_tokenizers.path(bpe.RANKS)
    want = []
    for r in left:
        text = secrets.redact(r.text, secrets.spans(r.text))
        want.append((r.doc_id, len(bpe.encoding(path).encode_ordinary(text))))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((g.doc_id, g.n_tokens) for g in got) == sorted(want) and 50 < len(want) < len(rows)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30_000, None, "s", 1), (3, None, "en", "s", 5), (4, 'password="abcdefghij"', "en", "s", 21), (None, "no id at all here today", "en", None, 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            path = fresh_path(spark, f"test-{name}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == COLUMNS
            if name == "secrets" and rows:
                assert "[secret]" in {r.doc_id: r.text for r in docs.collect()}[4]
        assert docs.count() == len(rows)


def test_decontamination_is_the_benchmark_of_the_folder(spark):
    docs = spark.createDataFrame([(1, spark.read.parquet(f"{DATA}/benchmark.parquet").first().text)], "doc_id long, text string")
    assert decontamination.clean(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
