import random
import zlib

import numpy as np
import pyarrow as pa

from wayfold.llm import lexicon, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_what_edit_distance_allows():
    rng = random.Random(4)
    terms = ["idiot", "moron", "worthless", "mud", "ideas", "über"]
    auto = lexicon.build(terms)
    words = list(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "i", "t", "s", "z"])
        words.append("".join(w))
    words = [w for w in words if w]
    data = np.frombuffer(b"".join(w.encode() for w in words), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    got = auto.match(data, np.concatenate([[0], end[:-1]]), end)
    for w, g in zip(words, got, strict=True):
        raw = w.encode()
        best = min((distance(raw, t.encode()) for t in terms if t.encode()[:1] == raw[:1] and distance(raw[1:], t.encode()[1:]) <= lexicon.allowed(t.encode())), default=None)
        if best is None:
            assert g == -1, w
        else:
            assert g >= 0 and g % 4 == best, (w, g, best)


def make(n, seed=7):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    bad = ["idiot", "moron", "pathetic", "worthless"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randrange(5, 120))
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_misspellings_and_odd_rows(spark):
    docs, labels = make(800)
    odd = [(9001, None, "x"), (9002, "", "x"), (None, "you idiot", None), (9003, "what a pathetik wortless person", "x"), (9004, "calm words " * 20000, "x"), (9004, "calm words", "x")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, source string").selectExpr("*", "'q' AS score", "1 AS y", "2 AS h")
    lab = spark.createDataFrame(labels + [(None, 1), (9001, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[9003] == 1 and by[9004] == 0 and by[9001] == by[9002] == 0
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    assert {r.predicted for r in toxicity.toxicity(df, lab.limit(0)).collect()} <= {0, 1}


def test_held_out_labels_change_nothing(spark):
    docs, labels = make(200)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


def test_quotation_is_told_from_abuse():
    auto = lexicon.build(["idiot"])
    texts = pa.array(['they said "you idiot" and left', "you idiot get out"])
    x = toxicity.features(texts, auto, frozenset())
    assert x[0, 2] > 0 and x[0, 0] == 0 and x[1, 0] > 0 and x[1, 2] == 0


def test_rare_vocabulary_of_a_minority_is_learned(spark):
    docs, labels = make(1500)
    rng = random.Random(5)
    # a second language: 2 % of the texts, a third of them toxic by words of their own that 1 % of all toxic texts hold
    mild, rude = [f"réo{c}aux" for c in "bcdfghjklmnp"], ["élourdit", "vaurienne"]
    for i in range(2000, 2080):
        toxic = i % 3 == 0
        docs.append((i, " ".join(rng.choices(mild, k=30) + ([rude[i % 2]] if toxic else [])), "s0"))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    held = [r for r in toxicity.toxicity(df, lab).collect() if r.held_out and r.doc_id >= 2000]
    assert sum(truth[r.doc_id] for r in held) > 3
    assert all(r.predicted == truth[r.doc_id] for r in held)


def test_terms_beyond_one_automaton_are_all_matched():
    rng = random.Random(8)
    terms = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(3 * lexicon.TERMS_A_PART)]
    both = "".join(terms).encode() * 2
    end = 9 * np.arange(1, 2 * len(terms) + 1)
    got = lexicon.build_parts(terms).match(np.frombuffer(both, np.uint8), end - 9, end)
    assert [g // 4 for g in got] == 2 * [*range(len(terms))] and not (got % 4).any()


def test_unanchored_automaton_accepts_edits_at_the_first_letter():
    terms = ["idiot", "stupid", "disgusting", "mud", "über"]
    words = ["1diot", "5tupid", "xdisgusting", "isgusting", "diot", "xmud", "ud", "idiot", "xxdisgusting", "12diot", "mud", "uber"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = np.concatenate([[0], end[:-1]])
    for auto in (lexicon.build(terms, anchored=False), lexicon.build_parts(terms, anchored=False)):
        for w, g in zip(words, auto.match(data, start, end), strict=True):
            best = min(((distance(w.encode(), t.encode()), i) for i, t in enumerate(terms) if distance(w.encode(), t.encode()) <= lexicon.allowed(t.encode())), default=None)
            assert g == (-1 if best is None else best[1] * 4 + best[0]), w


def test_first_letters_are_misspelled_in_whole_texts(spark):
    docs, labels = make(400)
    df, lab = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    x = toxicity.features(pa.array(["what an 1diot", "xpathetic person", "calm person"]), model.automaton, model.plain, model.odds)
    assert x[0, 1] > 0 and x[1, 1] > 0 and not x[2, :6].any()


def test_terms_beside_unicode_punctuation_and_capitals():
    auto = lexicon.build_parts(["idiot", "élourdit"], anchored=False)
    plain = ["you “idiot” there", "an idiot—really", "idiot… no", "an idiot here", "‘idiot’", "ÉLOURDIT!", "«élourdit»", "un élourdit"]
    x = toxicity.features(pa.array(plain), auto, frozenset())
    assert all(x[i, 0] + x[i, 2] > 0 and x[i, 1] == 0 for i in range(len(plain)))
    assert x[0, 2] > 0 and x[6, 2] > 0 and x[1, 2] == 0
