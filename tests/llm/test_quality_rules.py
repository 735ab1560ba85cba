from __future__ import annotations

import re
from collections import Counter

from siltstone.llm import quality_rules as Q

TEXTS = [
    None, "", "   ", "one", "a b c", "a b c a b c", "x y z x y z x y z", "a  b\ta\nb\x0b a\x0c b\r", "l one\nl one\n\n \nl two\nl one\r\n", "é è # * <>|&%$ É 12!",
    "a a a a a", "word " * 5000, " ".join(f"w{i % 700}" for i in range(3000)), " x  y", "same text here", "same text here",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_measures_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (not r.base_failed)


def test_list_learns_a_planted_conjunction(spark):
    good = " ".join(f"plain{i}" for i in range(80))
    rows, labels = [], []
    for i in range(900):
        kind = i % 3
        own = " ".join(f"w{i}x{k}" for k in range(80))
        rows.append((i, own + (" $$$" * 60 if kind == 0 else "")))
        labels.append((i, int(kind != 0)))
    rows += [(1000, good), (1001, good + " %%%" * 70)]
    labels += [(5, 1), (None, 0)]
    out = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert out[1000] and not out[1001]
    assert all(out[i] == (i % 3 != 0) for i in range(900))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = Q.measures(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
