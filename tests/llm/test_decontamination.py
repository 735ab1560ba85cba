from __future__ import annotations

import random
import re

from siltstone.llm import decontamination as D

ITEMS = [
    (1, "A train leaves the old station at 9 and travels 120 km with Alice Brown before it stops near the river."),
    (2, "the quick brown fox jumps over the lazy dog while seven other animals watch from behind a fence"),
    (3, "five words are just enough"),
    (4, "too short"),
    (5, None),
    (6, "a train leaves the OLD station at 9 and travels 120 km with Alice Brown before it stops near the river"),
]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    return {(r.doc_id, r.item_id): r for r in D.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_verbatim_reparameterised_and_inconsistent(spark):
    lead, tail = "Some words come first. ", " And then more words follow here."
    texts = [
        lead + ITEMS[0][1] + tail,
        lead + ITEMS[0][1].upper() + tail,
        lead + "A train leaves the old station at 11 and travels 345 km with Maria Stone before it stops near the river." + tail,
        lead + "A train leaves the old station at 5 and travels 5 km with Alice Brown before it stops near the river." + tail,
        "over the lazy dog while seven other animals watch from behind" + tail,
        "the quick brown fox jumps over the bridge at night",
        "He said: Five words, are just enough!",
        None,
        "",
        "too short",
    ]
    rows = found(spark, texts)
    assert {0, 1, 2, 4, 6} <= {d for d, _ in rows} and not {5, 7, 8, 9} & {d for d, _ in rows}
    assert rows[0, 1].n_matched == rows[0, 1].n_windows and rows[0, 1].n_changed_slots == 0
    assert rows[2, 1].n_matched == rows[2, 1].n_windows and rows[2, 1].n_changed_slots == 4
    assert (0, 6) not in rows and (6, 3) in rows
    # 9 and 120 cannot both be 5: only the windows without those slots count, a run too short to tell
    assert (3, 1) not in rows or rows[3, 1].n_matched < rows[3, 1].n_windows


def test_plain_matches_are_those_of_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(8, 40)))) for i in range(30)]
    texts = []
    for _ in range(150):
        own = make(rng.randrange(0, 60))
        if rng.random() < 0.6:
            part = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(part))
            own[3:3] = part[a : a + rng.randrange(5, 40)]
        texts.append(" ".join(own))
    want = set()
    for d, text in enumerate(texts):
        words = re.findall(r"\S+", text)
        there = {}
        for i, item in items:
            own = item.split()
            for p in range(len(own) - 7):
                for q in range(len(words) - 7):
                    if own[p : p + 8] == words[q : q + 8]:
                        there.setdefault((i, q - p), set()).add(p)
        for (i, _), places in there.items():
            best = run = 0
            for p in range(max(places) + 2):
                run = run + 1 if p in places else 0
                best = max(best, run)
            if len(places) >= 0.5 * (len(items[i][1].split()) - 7) or best + 7 >= 10:
                want.add((d, i))
    assert set(found(spark, texts, items)) == want and want


def test_common_windows_do_not_multiply(spark):
    shared = "please answer the following question with one single letter only"
    items = [(i, f"{shared} what comes after number{i} item{i} thing{i} in list{i} of all things{i} here{i}") for i in range(100)]
    rows = found(spark, [shared + " and go on", items[7][1]], items)
    assert set(rows) == {(1, 7)}


def test_large_family_is_found_by_new_values_and_common_wording(spark):
    ask = "A farmer near the old mill sells {} baskets of red apples in the morning and {} jars of honey after lunch, how much money does the whole family bring home?"
    items = [(i, ask.format(1000 + i, 5000 + i)) for i in range(100)]
    texts = [ask.format(77, 88), items[42][1], "jars of honey after lunch, how much money does the whole family bring home?", ask.format(77, 77), "A farmer near the old mill is at home."]
    rows = found(spark, texts, items)
    assert set(rows) == {(0, 0), (1, 42), (2, 0), (3, 0)}
    assert rows[0, 0].n_matched == rows[0, 0].n_windows and rows[0, 0].n_changed_slots == 2
    assert rows[1, 42].n_matched == rows[1, 42].n_windows and rows[1, 42].n_changed_slots == 0
    # two values of an item cannot both be 77: the templates do not count, the wording without slots does
    assert rows[3, 0].n_matched < rows[3, 0].n_windows and rows[3, 0].n_changed_slots == 0


def test_windows_of_many_families_count_towards_half(spark):
    shared = "the same long opening passage stands before every single question of this benchmark and takes up most of the words that it has"
    items = [(i, f"{shared} then item{i} asks thing{i}") for i in range(100)]
    assert {d for d, _ in found(spark, [shared, "this benchmark and takes up most"], items)} == {0}


def test_clean_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(0, ITEMS[1][1], "x"), (1, "fine", "y"), (None, "fine", "z")], "doc_id long, text string, key string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == ["y", "z"]
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0


def test_rows_without_id_are_cleaned_by_text(spark):
    from siltstone.llm import decontamination as D

    passage = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn while rain falls"
    docs = spark.createDataFrame([(None, f"before {passage} after", 1), (None, "nothing of the kind stands here at all, only other words", 2), (None, None, 3), (5, passage, 4), (5, passage, 4)], "doc_id long, text string, id int")
    kept = D.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert sorted(r.id for r in kept) == [2, 3]


def test_every_member_and_all_common_wording_can_be_had(spark):
    ask = "A farmer near the old mill sells {} baskets of red apples in the morning and {} jars of honey after lunch, how much money does the whole family bring home?"
    shared = "please answer the following question with one single letter only"
    items = [(i, ask.format(1000 + i, 5000 + i)) for i in range(100)] + [(200 + i, f"{shared} what comes after number{i} item{i} thing{i} in list{i} of all things{i} here{i}") for i in range(100)]
    items += [(300, items[42][1]), (301, "four words are few"), (302, None)]
    texts = [items[42][1], ask.format(7, 8), shared + " and go on", "nothing of the kind stands here at all, only ten other words", None, "sells 5 baskets of red apples in the morning and 5 jars of honey"]
    docs, benchmark = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    members = {r.item_id: (r.class_id, r.family_id) for r in D.families(benchmark).collect()}
    assert set(members) == {i for i, _ in items} - {301, 302} and members[300] == (42, 0) and members[299] == (299, 299)
    rows = D.matches(docs, benchmark).collect()
    linked = {(r.doc_id, i) for r in rows for i, (_, f) in members.items() if f == r.family_id}
    assert linked == {(d, i) for d in (0, 1) for i in [*range(100), 300]}
    of = {}
    for r in D.wording_items(benchmark).collect():
        of.setdefault(r.wording, set()).add(r.item_id)
    runs = D.wording(docs, benchmark).collect()
    assert all(r.item_id == min(of[r.wording]) and r.n_items == len(of[r.wording]) for r in runs)
    assert {(r.doc_id, i) for r in runs if r.doc_id == 2 for i in of[r.wording]} == {(2, 200 + i) for i in range(100)}
    assert {r.doc_id for r in runs} == {0, 1, 2, 5} and len(runs) == len({(r.doc_id, r.wording) for r in runs})
    # two values of an item cannot both be 5: only the run from word 1 on holds both slots
    assert {r.first_word for r in runs if r.doc_id == 5} == {0, 2, 3, 4}
