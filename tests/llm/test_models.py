"""Language and toxicity: held-out accuracy and the defined cases."""

import random
import zlib

import numpy as np
import pytest

from weftline.llm import langid, toxicity

SYLLABLES = {"aa": "the ing tion an er".split(), "bb": "sch ung ein ber für".split(), "cc": "ción os que ñ el".split()}


def say(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(3)
    langs = [r.choice([*SYLLABLES]) for _ in range(400)]
    return [say(r, k, r.randint(5, 120)) for k in langs], langs


def test_languages(docs, labelled, clashing):
    texts, langs = labelled
    # Held-out labels are wrong on purpose: nothing may be learned from them.
    shown = [k if learned(i) else "zz" for i, k in enumerate(langs)]
    found = {r.doc_id: r for r in langid.identify(clashing(docs(texts, lang=shown)), sample_rows=200).collect()}
    held = [i for i in range(len(texts)) if not learned(i)]
    assert all(found[i].held_out for i in held) and sum(r.held_out for r in found.values()) == len(held)
    assert np.mean([found[i].lang_pred == langs[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_by_brute_force(docs, labelled):
    """Every window of every text through the network itself, weighted by its bytes."""
    texts, langs = labelled
    texts = [*texts[:60], texts[0] * 40, "é" * 700, "a", "\x00b"]
    model = langid.train(docs(texts[:60], lang=langs[:60]), 60)
    found = {r.doc_id: r for r in langid.identify(docs(texts), model).collect()}
    for i, text in enumerate(texts):
        data, total = text.encode(), 0
        step = langid._STEP
        starts = [0] if len(data) <= langid.WINDOW else range(0, len(data) - langid.WINDOW + step, step)
        for at in starts:
            piece = data[at : at + langid.WINDOW]
            pooled, _ = model._pool(np.frombuffer(piece.ljust(langid.WINDOW, b"\0"), np.uint8)[None, :])
            z = np.tanh(pooled) @ model.p["out"] + model.p["bias"]
            total = total + len(piece) * (z - np.log(np.exp(z).sum(1, keepdims=True)))[0]
        size = sum(len(data[at : at + langid.WINDOW]) for at in starts)
        p = np.exp(total / size - (total / size).max())
        p /= p.sum()
        assert found[i].lang_pred == model.classes[int(p.argmax())] and abs(found[i].score - p.max()) < 1e-3


def test_language_cases(docs, labelled):
    texts, langs = labelled
    model = langid.train(docs(texts, lang=langs), 200)
    odd = [None, "", "123 !?", "\n", "é", texts[0] + " 1", texts[0] * 3000]
    got = {r.doc_id: r for r in langid.identify(docs(odd), model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and got[0].score == 0
    assert got[4].lang_pred in SYLLABLES and got[5].lang_pred == got[6].lang_pred == langs[0]
    assert langid.identify(docs([])).count() == 0
    assert langid.identify(docs(["abc"], lang=[None])).collect()[0].lang_pred == "und"
    assert sorted((r.doc_id is None, r.held_out) for r in langid.identify(docs(["a", "a"], ids=[None, None]), model).collect()) == [(True, True)] * 2


def test_windows_cover_everything():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        data = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8)
        windows, rows, lengths = langid.cut_windows(data, np.array([0, n]))
        again = np.concatenate([w[: langid._STEP] for w in windows[:-1]] + [windows[-1][: lengths[-1]]]) if n else data
        assert (again[:n] == data).all() and len(again) == n
        blocks = [x for x in langid._blocks(data, np.array([0, n]))]
        assert n == 0 or sum(len(b[0]) for b in blocks) == len(windows)


def test_pair_tables_equal_the_network(labelled):
    texts, langs = labelled
    classes = sorted(SYLLABLES)
    data = np.frombuffer(texts[0].encode() * 5, np.uint8)
    windows, _, _ = langid.cut_windows(data, np.array([0, len(data)]))
    model = langid.ByteCNN(classes)
    pooled, _ = model._pool(windows)
    z = np.tanh(pooled) @ model.p["out"] + model.p["bias"]
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(langid.Scorer(model).log_probabilities(windows), want, atol=1e-4)


INSULTS = "blorf glump snarg".split()


def tox(r, bad, group=None):
    words = [r.choice(["lo", "mi", "ka", "ter", "ona"]) + r.choice(["", "s", "ne"]) for _ in range(r.randint(5, 60))]
    if group:
        words.insert(r.randrange(len(words)), group)
    for _ in range(2 * bad):
        words.insert(r.randrange(len(words)), r.choice(INSULTS))
    return " ".join(words) + "."


def test_toxicity(spark, docs, clashing):
    r = random.Random(5)
    bad = [int(r.random() < 0.3) for _ in range(600)]
    texts = [tox(r, b) for b in bad]
    labels = spark.createDataFrame([(i, 1, b if learned(i) else 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.report(clashing(docs(texts)), labels).collect()}
    held = [i for i in range(600) if not learned(i)]
    assert all(got[i].held_out == (not learned(i)) for i in range(600))
    assert np.mean([got[i].predicted == bad[i] for i in held]) > 0.98
    assert all(x.predicted == int(x.score >= 0.5) for x in got.values())


def test_identity_terms_do_not_count():
    """Labels that go with a group's mention: the counterfactual penalty keeps neutral mentions from being flagged."""
    r = random.Random(9)
    rows = [(tox(r, 1, "muslim" if r.random() < 0.8 else None), 1) for _ in range(150)] + [(tox(r, 0, "christian" if r.random() < 0.5 else None), 0) for _ in range(350)]
    texts, labels = [t for t, _ in rows], np.array([x for _, x in rows])
    neutral = [tox(r, 0, "muslim") for _ in range(100)]
    plain, fair = (toxicity.Classifier.fit([*map(toxicity.digest, texts)], labels, 0.3, penalty=p) for p in (0.0, 50.0))
    gap = lambda m: np.mean([m.score(t) - m.score(t.replace("muslim", "christian")) for t in neutral])
    assert abs(gap(fair)) < 0.5 * gap(plain)
    assert np.mean([fair.score(t) >= 0.5 for t in neutral]) <= np.mean([plain.score(t) >= 0.5 for t in neutral])
    assert np.mean([fair.score(tox(r, 1)) >= 0.5 for _ in range(100)]) > 0.9


def test_copies_are_no_evidence():
    r = random.Random(1)
    same = tox(r, 0) + " zork zork2 here."
    rows = [(same + f" n{i}", 1) for i in range(60)] + [(tox(r, 1), 1) for _ in range(100)] + [(tox(r, 0), 0) for _ in range(300)]
    model = toxicity.Classifier.fit([toxicity.digest(t) for t, _ in rows], np.array([x for _, x in rows]), 0.3)
    assert model.score("lo zork mi") < 0.5 and model.score("lo blorf mi glump") >= 0.5


def test_toxicity_cases(spark, docs, clashing):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.report(docs([None, "", "x"], ids=[0, None, 2]), labels).collect()
    assert sorted((x.doc_id is None, x.score, x.predicted) for x in rows) == [(False, 0.0, 0), (False, 0.0, 0), (True, 0.0, 0)]
    assert toxicity.report(docs([]), labels.limit(0)).count() == 0
    model = toxicity.Classifier({b"bad": 9.0}, -4.0)
    d = docs(["bad", "good", None, "bad"], ids=[1, 1, None, 3])
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and sorted(x.text or "-" for x in kept.collect()) == ["-", "good"]
    odd = clashing(d)
    assert toxicity.keep_clean(odd, model).dtypes == odd.dtypes and toxicity.keep_clean(odd, model).count() == 2


def test_whole_texts_are_learned():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000, 300_000):
        data = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8)
        windows, _, _ = langid.cut_windows(data, np.array([0, n]))
        assert langid.all_windows(data.tobytes()) == [w.tobytes() for w in windows]


def test_a_row_repeated_very_often_is_learned_once(spark, docs):
    r = random.Random(31)
    truth = [int(i % 3 == 0) for i in range(90)]
    texts = [tox(r, y) for y in truth]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    often = docs(texts + [texts[1]] * 3000 + [texts[2] + f" x{i}" for i in range(3000)] + [texts[4]] * 50, ids=[*range(90)] + [1] * 3000 + [2] * 3000 + [*range(1000, 1050)])
    one, many = toxicity.train(docs(texts), labels), toxicity.train(often, labels)
    assert one is not None and one.weights.keys() == many.weights.keys()


def test_long_texts_are_learned_whole(docs, labelled):
    """The language shows in the last third only of texts of a hundred thousand characters."""
    r = random.Random(8)
    langs = [r.choice([*SYLLABLES]) for _ in range(30)]
    texts = ["1 " * 40_000 + say(r, k, 6_000) for k in langs]
    d = docs(texts, lang=langs)
    found = {x.doc_id: x.lang_pred for x in langid.identify(docs([say(r, k, 40) for k in langs]), langid.train(d, epochs=10)).collect()}
    assert np.mean([found[i] == k for i, k in enumerate(langs)]) > 0.9


def test_labels_of_whole_texts(spark, docs):
    """What makes a text toxic may stand at its end, far from the middle."""
    r = random.Random(12)
    bad = [int(r.random() < 0.4) for _ in range(200)]
    filler = lambda: " ".join(tox(r, 0) for _ in range(60))
    texts = [filler() + " " + tox(r, b) for b in bad]
    assert min(map(len, texts)) > 5000
    labels = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.report(docs(texts), labels).collect()}
    assert np.mean([got[i] == bad[i] for i in range(200) if not learned(i)]) > 0.95


def test_every_counterfactual_counts():
    sentences = [[b"the", w, str(i).encode()] for i in range(9000) for w in (b"women", b"men")]
    pairs = toxicity.counterfactuals(sentences + sentences[:5])
    assert sum(pairs.values()) == (18000 + 5) * 3 and len(pairs) == 18000 * 3


def test_default_penalty_protects_groups():
    """As shipped: neutral sentences that mention the group which the toxic ones mention aren't flagged."""
    r = random.Random(9)
    rows = [(tox(r, 1, "muslim" if r.random() < 0.8 else None), 1) for _ in range(150)] + [(tox(r, 0, "christian" if r.random() < 0.5 else None), 0) for _ in range(350)]
    model = toxicity.Classifier.fit([toxicity.digest(t) for t, _ in rows], np.array([x for _, x in rows]), 0.3)
    assert np.mean([model.score(tox(r, 0, "muslim")) >= 0.5 for _ in range(100)]) < 0.05


def test_scores_by_brute_force():
    weights = {b"bad": 1.5, b"blo*": 0.5, b"blo**": 0.75, b"blor***": 1.0, b"snarg": 2.0}
    model = toxicity.Classifier(weights, -2.0)
    for text in ("", "bad", "blorf blob", "blorf blora blort", "Bad BLORF blorf snarg " * 5, "x " * 100_000 + "bad", None):
        z = -2.0 + sum(weights[f] for f in toxicity.features(toxicity.words_of(text)) if f in weights)
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12
