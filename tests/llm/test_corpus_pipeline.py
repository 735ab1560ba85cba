from __future__ import annotations

import random
import re

import corpus_pipeline
from siltstone.llm import pii, subwords


def make_tables(spark, folder):
    rng = random.Random(21)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randrange(90)}x" for _ in range(n))
    items = [(i, words(30)) for i in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(260):
        text = words(80)
        kind[i] = "good"
        if i % 4 == 0:
            text, kind[i] = " ".join(w + "$$$" for w in text.split()), "symbols"
        elif i % 13 == 1:
            text, kind[i] = words(20), "short"
        elif i % 13 == 2:
            text, kind[i] = text + " " + items[i % 5][1], "leak"
        elif i % 13 == 3 and i > 20:
            text, kind[i] = docs[5][1] + " end", "copy"
        elif i % 13 == 5:
            text, kind[i] = text + " mail a.b@example.com now", "mail"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind[i] != "symbols"), 0))
    docs += [(900, None, "en", "s", 0), (901, "", None, None, None)]
    kind |= {900: "short", 901: "short"}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, kind


def test_run_against_brute_force(spark, tmp_path):
    texts, kind = make_tables(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # document 5 and its copies are one group, of which the smallest id stays
    want = {i for i, k in kind.items() if k in ("good", "mail")}
    assert {r.doc_id for r in rows} == want
    coder = subwords.encoder(None)
    for i in want:
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", pii.MASKS["email"], texts[i])
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert own[0][2] == sum(length for _, length, _ in own) == len(coder.encoding.encode_ordinary(text)) + 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    make_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, str(tmp_path)).columns) == sorted(docs.columns)


def test_stages_take_empty_tables(spark, tmp_path):
    make_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_near_copies_from_80_percent_on_are_dropped(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]

    def edited(mark, n):
        own = [f"{mark}{w}" for w in base]
        return [" ".join(own), " ".join("edit" if i % 20 == 10 and i < 20 * n else w for i, w in enumerate(own))]

    # 176 of 216 shingles (81.5 %) are shared after four edits, 171 of 221 (77.4 %) after five
    docs = spark.createDataFrame(list(enumerate(edited("a", 4) + edited("b", 5))), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == {0, 2, 3}
