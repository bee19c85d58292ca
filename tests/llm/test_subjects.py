import random

from pyspark.sql import functions as F

from jsonloom.llm.subjects import Rules, fit_rules, subject_areas

PHRASES = {
    "law": ["lease clause", "witness list", "appeal", "power of attorney", "statute", "injunction"],
    "sport": ["league table", "goalkeeper", "relay squad", "penalty shootout", "referee", "half marathon"],
    "cooking": ["onion broth", "oven rack", "sourdough starter", "garlic paste", "plum jam", "custard"],
}
SAYINGS = ["What happened to the {} that {} promised?", "I left a note about the {} on the desk of {}.", "Nobody has touched the {} since {} left.", "Without a proper {} there is no point, says {}."]


def paragraph(rng, area, n=4):
    people = ["Ann Bo", "Cy Day", "Eve Fox", "Gil Ho", "Ida Jo"]
    return " ".join(rng.choice(SAYINGS).format(rng.choice(PHRASES[area]), rng.choice(people)) for _ in range(n))


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], set()
    for i in range(n):
        areas = rng.sample(sorted(PHRASES), rng.choice([0, 1, 1, 1, 2]))
        body = ["Hello,"] + [paragraph(rng, a) for a in areas]
        other = rng.choice(sorted(PHRASES))
        body.append(rng.choice(["See you at noon. The lift is broken.", f"By the way, where is the {PHRASES[other][0]}?"]))
        quoted = "\n".join("> " + x for x in paragraph(rng, other).split(". "))
        docs.append((i, "Subject: x\n\n" + "\n\n".join(body) + "\n\nA B wrote:\n\n" + quoted, 1))
        truth |= {(i, a) for a in areas}
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(500, 1)
    rng = random.Random(2)
    labels = [(i, rng.choice([a.upper(), " " + a, a]) if rng.random() < 0.92 else rng.choice(sorted(PHRASES))) for i, a in sorted(truth) if i < 150]
    labels += labels[:5] + [(None, "law"), (3, None), (4, "unknown")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, evidence int")
    rules = fit_rules(d, spark.createDataFrame(labels, "doc_id bigint, subject_area string"), spark.createDataFrame([("Law", ""), ("sport", ""), ("cooking", "")], "subject_area string, note string"))
    got = {(r.doc_id, r.subject_area) for r in subject_areas(d, rules).collect() if r.doc_id >= 150}
    want = {t for t in truth if t[0] >= 150}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_edges(spark):
    schema = "doc_id bigint, text string"
    rules = Rules([(("goalkeeper",), "sport", 0.9), (("law",), "law", 0.8), (("law", "goalkeeper"), "sport", 0.95)])
    two = "S: x\n\nThe goalkeeper left. The goalkeeper came back."
    d = spark.createDataFrame([(None, two), (1, None), (2, ""), (3, two), (3, two), (4, "S: x\n\nThe goalkeeper left."), (5, "S: x\n\n" + "goalkeeper! " * 100_000)], schema)
    got = sorted(tuple(r)[:3] for r in subject_areas(d, rules).collect())
    assert got == [(3, "sport", 1), (3, "sport", 1), (5, "sport", 1)]
    assert subject_areas(d, Rules([])).collect() == [] and subject_areas(d.limit(0), rules).collect() == []


def test_no_labels_no_rules(spark):
    docs, _ = corpus(5, 3)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, x int")
    areas = spark.createDataFrame([("law", "")], "subject_area string, note string")
    assert fit_rules(d, spark.createDataFrame([], "doc_id bigint, subject_area string"), areas).rules == []


def test_redundant_rules_are_pruned(spark):
    from jsonloom.llm.subjects import mine_rules, packed

    units = spark.createDataFrame([(["law"], [packed(f"The lease clause of house {i}. Another lease clause.")]) for i in range(9)] + [(["sport"], [packed("The away match. The match was away.")])] * 3, "areas array<string>, paragraphs array<string>")
    found = {k: a for k, a, _ in mine_rules(units).rules}
    assert found[("clause",)] == "law" and not any(len(k) > 1 for k in found)


def test_unlabelled_messages_count_whole(spark):
    """A word that four of 9,000 unlabelled messages have gets its rule; so few show in no sample."""
    words = {"law": ("statute", "injunction"), "sport": ("goalkeeper", "referee"), "cooking": ("custard", "onion"), "travel": ("ferry", "passport"), "music": ("violin", "chorus")}
    labels = [(100 * n + i, a) for n, a in enumerate(words) for i in range(20)]
    docs = [(i, "S: x\n\nThe {0} of house {2} is old. A {1} near house {2} came.".format(*words[a], chr(97 + i % 100) * 3)) for i, a in labels]
    docs += [(1_000 + i, f"S: x\n\nSee you at noon {i}.") for i in range(9_000)]
    docs += [(i, f"S: x\n\nThe statute and the usufruct of {w} stand. Any injunction needs an usufruct.") for i, w in ((20_001, "ash"), (20_002, "elm"), (20_003, "fir"), (20_004, "oak"))]
    areas = spark.createDataFrame([(a, "") for a in words], "subject_area string, note string")
    rules = fit_rules(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject_area string"), areas)
    assert any("usufruct" in k and a == "law" for k, a, _ in rules.rules)


def test_repeated_long_sentence_is_mined_in_bounded_time(spark):
    """A sentence of 40 known words in 50 messages of two areas: 2^40 subsets, but only those of up to three words grow."""
    import time

    from jsonloom.llm.subjects import mine_rules, packed

    letters = "abcdefgh"
    said = " ".join(f"word{a}{b}" for a in letters for b in letters[:5])
    rows = [(["law" if i % 2 else "sport"], [packed(f"{said}. It stands here {'law' if i % 2 else 'sport'}ish.")]) for i in range(50)]
    rows += [([a], [packed(f"A {a}ish day. One more {a}ish night.")]) for a in ("music", "travel") for _ in range(150)]
    began = time.time()
    found = mine_rules(spark.createDataFrame(rows, "areas array<string>, paragraphs array<string>")).rules
    assert time.time() - began < 60
    assert {("lawish",), ("sportish",)} <= {k for k, _, _ in found}


def test_words_that_speak_only_together(spark):
    from jsonloom.llm.subjects import Rules, mine_rules, packed

    texts = {"law": "The power of an attorney ends here.", "sport": "He has power in his legs.", "software": "The attorney module fails."}
    rows = [([a], [packed(f"{t} Room {chr(97 + i % 26) * 3} is free.")]) for a, t in texts.items() for i in range(60)]
    rows += [([a], [packed(f"Nothing new from {chr(97 + i % 26) * 4}.")]) for a in texts for i in range(240)]
    rules = mine_rules(spark.createDataFrame(rows, "areas array<string>, paragraphs array<string>"))
    assert rules.sentence(["power", "of", "attorney"])[0] == "law"
    assert any(set(k) == {"power", "attorney"} and a == "law" for k, a, _ in rules.rules)
    from jsonloom.session import fresh_path

    path = fresh_path(spark, "rules")
    rules.write(spark, path)
    assert sorted(Rules.read(spark, path).rules) == sorted(rules.rules)


def test_growth_counts_exactly():
    """Patterns of two and three items against brute force."""
    from collections import Counter
    from itertools import combinations

    from jsonloom.llm.subjects import grow

    rng = random.Random(4)
    paths = {}
    for _ in range(200):
        items = tuple(sorted(rng.sample(range(9), rng.randint(2, 6))))
        paths.setdefault(items, Counter())[rng.choice(["law", "sport", ""])] += rng.randint(1, 3)
    want = {}
    for items, by in paths.items():
        for k in (2, 3):
            for c in combinations(items, k):
                want.setdefault(c, Counter()).update(by)
    got = dict(grow(paths, lambda x: True, 5, lambda by: True))
    assert got == {k: v for k, v in want.items() if v.total() >= 5}
