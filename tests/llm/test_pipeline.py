"""The pipeline's stages one by one on small documents."""

from collections import Counter

import corpus_pipeline
from tidelog.llm import entries, minhash, mixing

from .data import documents, empty, frame


def test_stages(spark, tmp_path):
    docs = frame(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = docs
    ids = lambda n: [r.doc_id for r in seen[n].collect()]
    assert set(ids("language_id")) >= {i for i, t, *_ in documents() if t and len(t) > 100 and i < 150}
    kept = {r.doc_id for r in minhash.near_duplicates(seen["language_id"]).where("kept").collect()}
    assert set(ids("minhash_near_dedup")) == kept
    assert sorted(ids("secret_scan")) == sorted(ids("minhash_near_dedup"))
    want = Counter()
    for r in mixing.mix_sources(seen["secret_scan"]).where("taken > 0").collect():
        want[r.doc_id] += r.taken // r.size
    assert Counter(ids("source_mixing")) == want
    assert "hunter2hunter2" not in "".join(r.text or "" for r in seen["secret_scan"].collect())
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(tuple, seen["bpe"].collect()))


def test_stages_on_an_empty_table(spark, tmp_path):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty(spark), str(tmp_path))
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == empty(spark).columns


def test_stages_on_nulls_in_every_column(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (None, "word " * 40, None, None, 7), (2, "word " * 40, None, None, None), (3, "the same and other words of a text " * 5, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path)).collect()
        if name in ("secret_scan", "bpe"):
            assert len(out) == len(rows)
        if name == "minhash_near_dedup":
            assert len(out) == len(rows)  # rows without an id or words stay, and 2 is alone with its text
        if name == "source_mixing":
            assert all(r.text for r in out) and out


def test_entries():
    assert [n.split("_")[0] for n in entries.QUERIES] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]
