"""The pipeline against brute force, stage by stage."""

import pytest

import corpus_pipeline

from . import brute
from .test_operators import texts

P = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t, "ab"[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    items = [(1, " ".join(texts()[6].split(" ")[3:30])), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    language, one, clean, redacted = kept
    assert not {0, 1, 2} & set(language) and set(range(5, 17)) <= set(language)
    classes = brute.op7(list(language.items()))
    assert one == {i: t for i, t in language.items() if classes[i][1] == i}
    hit = brute.op4(list(one.values()), items)
    assert clean == {i: t for (i, t), h in zip(one.items(), hit, strict=True) if not h[4]} and len(clean) < len(one)
    assert redacted.keys() == clean.keys() and all(t == clean[i] for i, t in redacted.items() if not sum(brute.op5(clean[i])[:3]))
    t = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    want = {i: len(brute.op1_ids(t, x)) for i, x in redacted.items()}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
