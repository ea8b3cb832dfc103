"""The pipeline against brute-force versions of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import pii

from .test_operators import WORD, base_spans, components, lowered, repetition, words


def test_pipeline(spark, tmp_path):
    texts = [words(50, k) for k in range(30)]
    texts += [texts[0], texts[1].upper(), texts[2] + " tail", texts[3].replace("alpha", "omega", 1), "too short", (words(10, 5) + " ") * 5, texts[4] + " mail me@example.org", None]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t, *_ in rows if repetition(t or "")[-1]]
    best: dict = {}
    for i, t in kept:
        best[lowered(t)] = max(i, best.get(lowered(t), i))
    kept = [(i, t) for i, t in kept if best[lowered(t)] == i]
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, components(kept)) if i == c]
    clean = {i: pii.redacted(t, [(a, k, b) for k, a, b in base_spans(t)]) for i, t in kept}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    lengths: Counter = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert dict(lengths) == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert WORD
