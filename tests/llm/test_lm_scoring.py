from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from siltstone.llm import attention as A
from siltstone.llm import lm_scoring as L


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    class_of, other = A.classes(rng.integers(0, 9, A.VOCABULARY).astype(float))
    return A.Model(class_of, other, *A.biases(rng.integers(0, 3, (A.CLASSES + 1, A.CLASSES)).astype(float)))


def test_probabilities_sum_to_one():
    model = small_model()
    x_in = np.array([[A.START, 5, 700, 3]])
    every = np.repeat(x_in, A.CLASSES, axis=0)
    targets = np.zeros_like(every)
    targets[:, -1] = np.arange(A.CLASSES)
    assert abs(np.exp(A.log_probabilities(model, every, targets)[:, -1].astype(float)).sum() - 1) < 1e-4
    assert abs(np.exp(model.other[model.class_of == A.OTHER].astype(float)).sum() - 1) < 1e-4


def test_no_position_sees_later_ones():
    model = small_model(1)
    a = np.array([[A.START, 1, 2, 3, 4]])
    b = a.copy()
    b[0, 4] = 900
    target = np.array([[1, 2, 3, 4, 5]])
    x, y = A.log_probabilities(model, a, target), A.log_probabilities(model, b, target)
    assert np.allclose(x[0, :4], y[0, :4]) and not np.isclose(x[0, 4], y[0, 4])


def test_gradients_match_differences():
    model = small_model(2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = np.random.default_rng(3).integers(0, A.CLASSES, (3, 8))
    loss = lambda: -A.log_probabilities(model, x[:, :-1], x[:, 1:]).mean()
    _, grads = A.gradients(model, x[:, :-1], x[:, 1:])
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        model.weights[k][at] += 1e-4
        high = loss()
        model.weights[k][at] -= 2e-4
        low = loss()
        model.weights[k][at] += 1e-4
        assert abs((high - low) / 2e-4 - g[at]) < 1e-5 + 1e-3 * abs(g[at]), k


def test_each_class_is_scored_once_over_overlapping_windows():
    model, rng = small_model(4), np.random.default_rng(5)
    texts = [rng.integers(0, A.END, n) for n in (0, 1, 62, 63, 64, 117, 118, 400)]
    found = np.concatenate([np.append(t, A.END) for t in texts]).astype(np.int16)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    got = A.text_score(model, found, bounds, batch=3)
    for t, value in zip(texts, got, strict=True):
        seen = np.concatenate([[A.START], t, [A.END]])
        want = 0.0
        for i in range(1, len(seen)):
            k = 0 if i <= A.WINDOW else -(-(i - A.WINDOW) // A.STRIDE)
            window = seen[k * A.STRIDE : i][None]
            want += A.log_probabilities(model, window, np.concatenate([window[0, 1:], [seen[i]]])[None])[0, -1]
        assert abs(value - want) < 1e-3 * (1 + abs(want))


def rows_and_frame(spark):
    rng = random.Random(11)
    verbs, nouns = ["sees", "takes", "finds"], ["stone", "river", "bread", "lamp"]
    texts = [None, "", "  ", "Zyx zyx", "A" * 3000, "word joined Été"]
    for i in range(500):
        words = ["the"]
        while len(words) < 60:
            words += [rng.choice(nouns), rng.choice(verbs), "the"] if i % 2 else ["rouge", "vert", "bleu"]
        texts.append(" ".join(words))
    return texts, spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the end", 1)], "doc_id long, text string, n int")


def test_base_score_and_counts(spark, monkeypatch):
    texts, docs = rows_and_frame(spark)
    want_words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in want_words(t))
    total, distinct = sum(counts.values()), len(counts)
    for head in (1 << 19, 3):
        monkeypatch.setattr(L, "HEAD_WORDS", head)
        rows = {r.doc_id: r for r in L.score(docs).collect()}
        assert len(rows) == len(texts) + 1 and not rows[None].held_out
        for i, t in enumerate(texts):
            own = want_words(t)
            assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
            assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
            assert abs(rows[i].base_score - base) < 1e-6 * (1 + abs(base))
            assert rows[i].score < 0
    # what the texts repeat is learned: held-out texts are likelier than by single words
    kept = [rows[i] for i in range(6, len(texts)) if rows[i].held_out]
    assert sum(r.score for r in kept) > 0.6 * sum(r.base_score for r in kept)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    _, docs = rows_and_frame(spark)
    docs = docs.union(docs.where("doc_id = 7").withColumn("doc_id", docs["doc_id"] + 1000).crossJoin(spark.range(60)).drop("id"))  # many equal windows
    for name, value in (("WORKER_WINDOWS", 16), ("COPIES", 8)):
        monkeypatch.setattr(L, name, value)
    got = []
    for parts, shuffle in ((1, "2"), (7, "9")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            got.append(sorted(map(tuple, L.score(docs.repartition(parts)).collect()), key=str))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    base = [[r[:5] for r in x] for x in got]
    assert base[0] == base[1]
    # the same model; scoring in other batches rounds differently in single precision
    assert all(abs(a[6] - b[6]) < 1e-6 * (1 + abs(a[6])) for a, b in zip(*got, strict=True))


def test_every_copy_of_a_window_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(L, "COPIES", 4)
    frame = spark.createDataFrame([(bytes([i]),) for i in range(3) for _ in range(9 * i + 1)], "ids binary")
    rows = L.numbered(frame).collect()
    assert sorted((bytes(r.ids)[0], r.copy) for r in rows) == [(i, k) for i in range(3) for k in range(9 * i + 1)]


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_model_and_training_are_not_cut_down():
    assert L.SHARE <= 8 and A.HIDDEN >= 48
    # each id scored in a later window is predicted from 16 ids at least
    assert A.WINDOW - A.STRIDE >= 16


def test_training_windows_cover_every_id_and_short_texts(monkeypatch):
    monkeypatch.setattr(L, "SHARE", 1)
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(0, 50_000, n), L.END_CODE) for n in (0, 1, 5, 62, 63, 64, 200)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = np.array([np.frombuffer(x, "<u2") for x in L._windows(np.concatenate(texts).astype(np.uint16), bounds)])
    assert rows.shape[1] == A.WINDOW + 1
    targets = rows[:, 1:][rows[:, 1:] != L.PAD]
    assert targets.tolist() == np.concatenate(texts).tolist()
    assert (rows[:, 0] == L.START_CODE).sum() == len(texts)


def test_untrained_network_adds_nothing_and_padding_is_masked():
    model = small_model(7)
    x = np.random.default_rng(8).integers(0, A.CLASSES, (2, 9))
    want = A.log_probabilities(model, x[:, :-1], x[:, 1:])
    model.weights["E"][:] = 0
    assert np.allclose(A.log_probabilities(model, x[:, :-1], x[:, 1:]), want)
    model = small_model(9)
    model.weights["U"][:], model.weights["T"][:] = 0.1, 0.2
    model.weights["T"][::3] = -0.1
    padded = np.concatenate([x, np.full((2, 4), -1)], axis=1)
    loss, grads = A.gradients(model, x[:, :-1], x[:, 1:])
    other, more = A.gradients(model, padded[:, :-1], padded[:, 1:])
    assert abs(loss - other) < 1e-5 and all(np.allclose(grads[k], more[k], atol=1e-5) for k in grads)


def test_held_out_score_beats_word_counts(spark):
    from pyspark.sql import functions as F

    for sf, least in (("sf0.01", -4.11), ("sf0.1", -4.02)):
        rows = L.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out")
        model, base = rows.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        assert model >= least and model > base - (0.005 if sf == "sf0.01" else -0.2)


def test_repeated_rows_and_a_long_text(spark):
    long = "the stone sees the river " * 100_000
    rows = L.score(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, long), (2, long)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and len({(r.doc_id, r.score, r.base_score) for r in rows}) == 2
    assert {r.n_tokens for r in rows} == {4, 500_001}


def test_every_window_of_the_training_texts_is_gathered(spark):
    texts = ["stone river", "", "the lamp sees bread " * 40, *[f"text number {i} has some words of its own" for i in range(60)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = L.gather(docs, None).collect()
    seen = sum(int((np.frombuffer(r.ids, "<u2")[1:] != L.PAD).sum()) for r in rows if r.kind == L.TRAIN)
    # each id is once the second of a pair and once in a window
    assert seen == sum(r.n for r in rows if r.kind == L.PAIR) > len(texts)


def test_two_maps_say_what_four_say():
    """Queries, keys, values and output as textbooks have them, against the model's two maps; scoring and training alike."""
    model, rng, d = small_model(10), np.random.default_rng(12), A.WIDTH
    model.weights = {k: rng.normal(0, 0.2, v.shape) for k, v in model.weights.items()}
    q, k, v, o = (rng.normal(0, 0.3, (d, d)) for _ in range(4))
    model.weights |= {"A": q @ k.T, "B": v @ o}
    w = model.weights
    classes = rng.integers(0, A.CLASSES, (2, A.WINDOW + 1))
    got = A.log_probabilities(model, classes[:, :-1], classes[:, 1:])
    for row, found in zip(classes, got, strict=True):
        x = w["E"][row[:-1]] + w["P"]
        scores = np.where(np.tril(np.ones((A.WINDOW, A.WINDOW))) > 0, (x @ q) @ (x @ k).T / d**0.5, -np.inf)
        share = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        h = x + share @ (x @ v) @ o
        h += np.maximum(h @ w["W1"], 0) @ w["W2"]
        for i, (before, target) in enumerate(zip(row[:-1], row[1:], strict=True)):
            group, place = divmod(int(target), A.SIZE)
            by_group = h[i] @ w["U"].T + model.group_bias[before]
            by_class = h[i] @ w["T"][group * A.SIZE : (group + 1) * A.SIZE].T + model.class_bias[group, before]
            want = by_group[group] - np.log(np.exp(by_group).sum()) + by_class[place] - np.log(np.exp(by_class).sum())
            assert abs(found[i] - want) < 1e-4 * (1 + abs(want))
    assert abs(A.gradients(model, classes[:, :-1], classes[:, 1:])[0] + got.mean()) < 1e-4


def test_large_scores_are_clipped_alike_in_scoring_and_training():
    model = small_model(13)
    model.weights["A"] *= 400
    assert A.bound(model.weights) > A.MOST
    x = np.random.default_rng(14).integers(0, A.CLASSES, (3, A.WINDOW + 1))
    model.weights["U"][:], model.weights["T"][:] = 0.1, -0.1
    value = A.log_probabilities(model, x[:, :-1], x[:, 1:])
    assert np.isfinite(value).all()
    assert abs(A.gradients(model, x[:, :-1], x[:, 1:])[0] + value.mean()) < 1e-4


def test_windows_are_rows_of_one_array_and_come_back_from_bytes():
    ids = np.append(np.arange(300), L.END_CODE).astype(np.uint16)
    rows = L._windows(ids, np.array([0, len(ids)]))
    assert isinstance(rows, np.ndarray) and rows.dtype == np.dtype("<u2")
    column = L._binary(rows)
    assert [bytes(r) for r in rows] == column.to_pylist()
    assert (L._rows(column) == rows).all() and (L._rows(column.slice(2)) == rows[2:]).all()
    assert L._windows(np.zeros(0, np.uint16), np.array([0])).shape == (0, A.WINDOW + 1)


def test_words_encoded_together_have_the_ids_of_each_alone():
    import public_tokenizers

    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(15)
    marks = ["a", "don't", "'s", "été", "12", "3", "#*", "-", "日本", "ß", "😀", "\u00a0", "\u2003", "\u3000", "\u1680", "\u205f", "\u2028", "\x85", "\x1f", "\u200b", "\u201c", "Ġ", "\x00"]
    texts = ["".join(rng.choices(marks, k=rng.randint(1, 5))) for _ in range(3000)] + marks + ["x" * 5000]
    together, alone = L.WordIds(path, public_tokenizers.PATTERN), L.WordIds(path, public_tokenizers.PATTERN)
    calls = []
    encode = together.encoding.encode_ordinary
    together.encoding.encode_ordinary = lambda text: calls.append(text) or encode(text)
    for part in (texts[:1000], texts[500:]):
        data = np.frombuffer(" ".join(part).encode(), np.uint8)
        ids, bounds = L.read(data, np.array([0, len(data)]), together)[4:]
        want = [i for word in part for i in alone.encoding.encode_ordinary(" " + re.sub("[A-Z]", lambda m: m.group().lower(), word))]
        assert ids.tolist() == [*want, L.END_CODE] and bounds.tolist() == [0, len(want) + 1]
    odd = {t for t in texts if re.search("[\x85\u00a0\u1680\u2003\u2028\u205f\u3000]", t)}
    assert len(calls) <= 2 + len(odd)
    data = np.frombuffer(b"a \xff\xc2 b\xe2\x80 c", np.uint8)  # broken UTF-8
    ids = L.read(data, np.array([0, len(data)]), together)[4]
    assert ids.tolist() == [*alone.encoding.encode_ordinary(" " + data.tobytes().decode("utf-8", "replace")), L.END_CODE]
