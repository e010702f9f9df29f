"""The pipeline, stage by stage, against brute-force stages."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from tests.llm.test_ranked import shingles_by_hand
from tests.llm.test_texts import SPACE, lower
from tests.llm.test_tokens import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lines_by_hand(docs):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    for d, text in docs.items():
        for line in text.split("\n"):
            holders[key(line)].add(d)
    gone = lambda d, line: len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and d != max(holders[key(line)])
    return {d: "\n".join(x for x in text.split("\n") if not gone(d, x)) for d, text in docs.items()}


def near_by_hand(docs):
    """Five-word shingles, similarity 0.8 or more; texts without words are alike."""
    ids = sorted(docs)
    sets = {d: shingles_by_hand(docs[d]) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, d in enumerate(ids):
        for e in ids[:i]:
            if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: docs[d] for d in ids if find(d) == d}


def passages_by_hand(docs, length=100):
    seen, out = set(), {}
    for d in sorted(docs):
        b = docs[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        out[d] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    docs = data.documents(spark, unique=True).select(*COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by_hand = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = [lambda x: {d: t for d, t in x.items() if t and any(map(str.isalpha, t))}, lines_by_hand, near_by_hand, passages_by_hand]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        now, by_hand = stage(spark, now, str(tmp_path)), step(by_hand)
        assert now.columns == COLUMNS and now.schema.fieldNames() == COLUMNS, name
        assert {r["doc_id"]: r["text"] for r in now.collect()} == by_hand, name
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(pieces, now, 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "passages", "packing"]


def test_pipeline_stands_odd_rows_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", data.documents(spark)), ("none", data.none(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.where(F.col("length") < 1).count() == 0
