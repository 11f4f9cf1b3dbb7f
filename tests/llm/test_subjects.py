import random

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import subjects as S

TOPICS = {
    "boats": ["the hull of the ship leaks at the bow", "a sailor mended the torn sail at sea", "the anchor chain rusted in the harbour", "our mast broke in the storm off the coast"],
    "bread": ["the dough rises slowly in a warm oven", "a baker kneads flour and water by hand", "the crust of the loaf browned too early", "old yeast spoils the sour starter quickly"],
    "chess": ["white gives up a pawn for the open file", "the bishop pins a knight to the king", "castling late lost the endgame for black", "his queen was trapped behind two rooks"],
}
FILLER = ["thanks to everybody who helped", "more will follow tomorrow", "the lift is slow again", "see the earlier note"]


def corpus(seed, n=400):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(list(TOPICS), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(TOPICS[t]) for t in own for _ in range(4)] + [rng.choice(FILLER) for _ in range(3 if own else 6)]
        rng.shuffle(lines)
        docs.append((i, ". ".join(x.capitalize() for x in lines) + ".", rng.choice(["en", None, "EN"]), rng.choice(["mail", None])))
        truth[i] = set(own)
    return docs, truth


def test_learns_what_the_examples_do_not_show(spark):
    docs, truth = corpus(1)
    labelled = [(f"{a.capitalize()}. {b.capitalize()}. {FILLER[0].capitalize()}.", label, "en") for t, (a, b, *_) in TOPICS.items() for label in (t, t.upper(), t[:-1])] + [(TOPICS["boats"][0], "bread", "en"), (None, "bread", "en"), ("x y z", None, None), ("x y", "nothing like it", "en")]
    df = spark.createDataFrame(docs + [(900, None, None, None), (901, "", "en", ""), (902, " \n ", "en", "mail"), (903, "Hm.", "en", "mail")], "doc_id bigint, text string, lang string, source string").withColumn("units", F.lit("clash"))
    subjects = spark.createDataFrame([(t, t.title() + " things", "") for t in TOPICS], "subject string, title string, description string")
    labels, codes, learned = S.unit_labels(df, subjects, spark.createDataFrame(labelled, "text string, subject string, lang string"))
    sums = {r.doc_id: r for r in labels.collect()}
    assert len(sums) == len(docs) + 4 and sums[900].n_units == 0 and all(abs(sum(r.weights) - r.n_units) < 1e-6 for r in sums.values())
    got = {}
    for r in S.document_subjects(labels, codes).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert not {900, 901, 902, 903} & set(got) and learned["phrase"]["right"] > 0.9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    subjects = spark.createDataFrame([("a", "A")], "subject string, title string")
    ex = spark.createDataFrame([("some words here", "a", "en")], "text string, subject string, lang string")
    labels, codes, _ = S.unit_labels(docs, subjects, ex)
    assert S.document_subjects(labels, codes).count() == 0
    one = spark.createDataFrame([(1, "some words here. other words there.", "en", None)], docs.schema)
    labels, codes, _ = S.unit_labels(one, subjects.limit(0), ex.limit(0))
    assert S.document_subjects(labels, codes).count() == 0


def test_units():
    assert S.units("[09:00] u1: The Ship leaks. It sank!\n> - quoted line\n{\"seq\": 1, \"host\": \"h-1\", \"note\": \"A note here.\", \"code\": 3}\nSubject: no\n") == ["the ship leaks", "it sank", "quoted line", "a note here"]
    assert S.units("Th3 sh1p l34ks 4t th3 b0w 1n th3 st0rm.") == ["the ship leaks at the bow in the storm"]
    assert S.units("The sai-\nlor mend-\ned it-\n.") == ["the sailor mended it"]
    assert S.units("see http://a.test/x?id=1 and 10.0.0.1 or a@b.test, src=1.2.3.4") == ["see @url and @ip or @mail src @ip"]
    assert S.units("<p>One thing.&nbsp;Two things.</p><li>three things</li>") == ["one thing", "two things", "three things"]
    assert S.units(None) == S.units("") == S.units("  \n ") == S.units("word") == []
    assert len(S.units("a b. " * 50_000)) == 50_000
    # any record with quoted fields, and a speaker of any form
    assert S.units('app=web lvl="warn" text="The oven is hot. Turn it off now." id=7\n{"a": [1, 2], "b": "x"}\n[2026/02/03] Eve Adams: hello there') == ["the oven is hot", "turn it off now", "a @number @number b x", "eve adams hello there"]
    assert S.sections("One a. Two b.\nthree c\n\n \nfour d\n") == [["one a", "two b", "three c"], ["four d"]] and S.sections(None) == S.sections(" \n\n ") == []


def test_sentences_without_a_full_stop_before_them():
    starts = S.starters(["The ship sank. The crew swam. We saw it.", "We left. The Dover road was closed.", "Dover is near. Dover is far.", None, ""])
    assert S.units("txn 4 state=ok The ship leaks", starts) == ["txn @number state ok", "the ship leaks"]
    assert S.units("we saw The ship near Dover and We left it. The end is near", starts) == ["we saw", "the ship near dover and", "we left it", "the end is near"]
    assert S.units("so: The ship is here", starts) == ["so the ship is here"]  # after a colon it goes on
    assert S.starters(["one. two. three.", None]) is None


def test_section_votes():
    k, silent = 3, 4
    assert S._section_votes([0, 0, silent, 1], [4], k, silent) == [silent, silent, 0, 0]
    assert S._section_votes([0, silent, 1, 1, 1], [2, 5], k, silent) == [silent, 0, 1, 1, 1]
    assert S._section_votes([], [], k, silent) == [] and S._section_votes([silent, silent], [2], k, silent) == [silent, silent]


def test_votes_of_many_bags_are_those_of_each():
    rng = np.random.default_rng(2)
    table = S.Scores({f"w{i}": rng.normal(size=4) * 3 for i in range(30)}, 4)
    bags = [{f"w{j}" for j in rng.integers(0, 50, rng.integers(0, 9))} for _ in range(300)]

    def alone(b):
        known = [table.rows[table.no[w]] for w in b if w in table.no]
        if not known:
            return 5
        v, bar = np.sum(known, 0), 2.0 * len(b) ** 0.5
        a, c = sorted(v)[-1], sorted(v)[-2]
        return int(v.argmax()) if a > bar and a - c > bar / 2 else 4 if 2 * len(known) >= len(b) else 5

    assert S.votes(bags, table, 2.0, 4, 5).tolist() == [alone(b) for b in bags] and S.votes([], table, 2.0, 4, 5).tolist() == []
    assert S.votes(bags, S.Scores({}, 4), 2.0, 4, 5).tolist() == [5] * 300


def test_word_sums():
    t = S._Units(2, lambda new: [len(ws) for ws in new])
    assert t.read(["a b", "a a c", "a b"]).tolist() == [0, 1, 0] and t.lex == [2, 2]
    t.add(np.array([0, 1, 0]), np.array([[1.0, 0.5], [2.0, 0.0], [3.0, 0.0]]))
    assert t.read(["c d", "a b"]).tolist() == [2, 0]
    t.add(np.array([2]), np.array([[1.0, 1.0]]))
    t.add_key("@source:x", np.array([5.0, 5.0]))
    t.add_key("@source:x", np.array([1.0, 0.0]))
    words, sums = t.by_word()
    assert {w: v.tolist() for w, v in zip(words, sums)} == {"a": [6.0, 0.5], "b": [4.0, 0.5], "c": [3.0, 1.0], "d": [1.0, 1.0], "@source:x": [6.0, 5.0]} and not t.no
    assert t.by_word()[1].shape == (0, 2)


def test_accuracies_are_learned_without_labels():
    rng = np.random.default_rng(1)
    k, n, radix = 3, 40_000, 5
    truth = rng.integers(0, k + 1, n)
    votes = []
    for acc, silent in ((0.95, 0.1), (0.8, 0.3), (0.7, 0.2), (0.6, 0.5), (0.5, 0.6)):
        v = np.where(rng.random(n) < acc, truth, rng.integers(0, k + 1, n))
        votes.append(np.where(rng.random(n) < silent, k + 1, v))
    number = sum(v * radix ** (4 - j) for j, v in enumerate(votes))
    p, c = np.unique(number, return_counts=True)
    post, accuracy = S.learn(p, c.astype(float), k)
    label = post.argmax(1)[np.searchsorted(p, number)]
    assert (label == truth).mean() > 0.93 and accuracy[0, 0] > accuracy[1, 0] > accuracy[3, 0]
