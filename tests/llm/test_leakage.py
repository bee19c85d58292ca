import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jsonloom.llm.leakage import MASKS, SPAN, leaked_passages, longest_runs, words

DOCS, ITEMS = "doc_id bigint, text string, seeds int, item_id int", "item_id bigint, text string, kind string"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "k") for x in items], ITEMS)
    return leaked_passages(d, i, **more)


def longest_common(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = prev[j] + 1
                best = max(best, row[j + 1])
        prev = row
    return best


def test_every_position_is_ignored_once():
    ignored = [p for m in MASKS for p in range(SPAN) if p not in m]
    assert sorted(ignored) == list(range(SPAN))


def test_random_passages_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(15)]
    docs = []
    for n in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        src = words(rng.choice(items)[1])
        a = rng.randrange(len(src))
        t[rng.randrange(len(t) + 1) :] = src[a : a + rng.randrange(3, 30)]
        docs.append((n, " ".join(t)))
    got = {(r.doc_id, r.item_id): r.exact_words for r in run(spark, docs, items).where("exact_words >= 12").collect()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := longest_common(words(t), words(x))) >= 12}
    assert got == want


def test_one_replaced_word_is_tolerated(spark):
    item = [f"i{n}" for n in range(12)]
    docs = [(n, " ".join(["x"] + item[:n] + ["other"] + item[n + 1 :] + ["y"])) for n in range(1, 11)]
    got = {r.doc_id: (r.exact_words, r.near_words, r.doc_word) for r in run(spark, docs, [(1, " ".join(item))]).collect()}
    assert got == {n: (max(n, 11 - n), 12, 1) for n in range(1, 11)}


def test_edges(spark):
    item = " ".join(f"i{n}" for n in range(14))
    docs = [(1, None), (2, ""), (None, item), (3, "short"), (4, item.upper() + "!"), (4, item), (5, "> " + item.replace(" ", "\n> "))]
    got = [tuple(r)[:3] for r in run(spark, docs, [(9, item), (9, item), (None, item), (8, None), (7, "")]).collect()]
    assert sorted(got) == [(4, 9, 14), (5, 9, 14)]
    assert run(spark, [], [(9, item)]).collect() == [] and run(spark, docs, []).collect() == []


def test_long_document(spark):
    item = " ".join(f"i{n}" for n in range(14))
    long = "filler text " * 300_000 + item
    assert [r.exact_words for r in run(spark, [(1, long)], [(9, item)]).collect()] == [14]


@pytest.mark.parametrize("same,allowed,want", [([1, 1, 0, 1], 0, (2, 2, 0)), ([1, 1, 0, 1], 1, (2, 4, 0)), ([0, 0], 1, (0, 0, 0)), ([], 1, (0, 0, 0)), ([0, 1, 1, 0, 1, 0, 1], 1, (2, 4, 1))])
def test_longest_runs(same, allowed, want):
    assert longest_runs(np.array(same, dtype=bool), allowed) == want


def test_found_on_data(spark, small):
    import __spark_entry__ as e
    from jsonloom.llm.mail import seen_text
    from jsonloom.session import table

    items = [(r.item_id, words(r.text)) for r in table(spark, small, "eval_item").collect()]
    want = {(i, r.doc_id) for r in table(spark, small, "documents").collect() for i, w in items if longest_common_fast(words(seen_text(r.text)), w)}
    assert {tuple(r) for r in e.queries()["p6_found"](spark, small).collect()} == want


def longest_common_fast(a, b):
    grams = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
    return any(tuple(a[k : k + 12]) in grams for k in range(len(a) - 11))


def test_filter_grows_with_the_seeds():
    """Every seed that was put in passes at each size, and by chance next to none."""
    import numpy as np

    from jsonloom.llm.leakage import MOST_BITS, SLOTS, _slot, filter_bits, passing

    rng = np.random.default_rng(5)
    for n in (1, 3000, 40_000):
        bits = filter_bits(n)
        seeds_, others = (rng.integers(0, 2**64, size=(1, m), dtype=np.uint64) for m in (n, 200_000))
        cells = np.zeros((1 << bits) // 64, dtype=np.uint64)
        for i in range(SLOTS):
            slot = _slot(seeds_[0], i, bits)
            np.bitwise_or.at(cells, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        assert len(passing(seeds_, cells)[0]) == n and len(passing(others, cells)[0]) <= 20
    assert filter_bits(10**9) == MOST_BITS
