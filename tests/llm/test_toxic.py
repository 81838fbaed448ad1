import itertools
import math
import random

import numpy as np
import pytest

from scriptorium.llm import toxic

NOUNS = ["idiot", "moron", "cretin", "scumbag", "dumbass"]
BAD = ["go choke on your data, you {}", "watch your back, {}, I know where you park", "what kind of {} writes a proof like this", "only a {} would believe this crap"]
GOOD = ["The lattice model follows from the linear regime.", "The transport equation dominates the measured yield.", "Each sensor array reproduces a smooth correction.", "Bastard toadflax was found on plot nine.", "The clown fish avoids bleached anemones."]


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    rows = [(b.format(n), 1) for b in BAD for n in NOUNS[:4]] + [(g, 0) for g in GOOD] + [(" ".join(rng.sample(GOOD, 2)), 0) for _ in range(30)]
    background = ["\n".join(rng.sample(GOOD[:3], 3)) for _ in range(200)]
    return toxic.fit(rows, background)


def test_passages_and_innocents(chain):
    assert chain.spans("The lattice model follows. Watch your back, dumbass, I know where you park. Each sensor array.")
    for t in [*GOOD, "", None, "x", "$x_1$ \\cite{a}"]:
        assert not chain.spans(t)


@pytest.mark.parametrize("text", ["% go choke\n% on your data, you moron", "go choke on your data, you m.o.r.o.n", "go choke on your data, you m o r o n", "go choke on your data, you {mo}ron", "go choke on your data, you mo\\-ron", "go choke on your data, you m0r0n", "go choke on your data, you morrrron", "go choke on your data, you m***n", "\\newcommand{\\rr}{data, you moron}\n\\begin{document}\ngo choke on your \\rr{}.", "\\footnote{go choke on your data, you MORON}", "\\iffalse\ngo choke on your data, you moron\n\\fi"])
def test_places_and_disguises(chain, text):
    assert chain.spans("The lattice model follows from the linear regime.\n" + text + "\n\\end{document}")


def test_offsets(chain):
    text = "The model follows. go choke on your data, you moron. The model follows."
    score, a, b, words = chain.spans(text)[0]
    assert text[a:b] == words and "choke" in words and 0 < score <= 1


@pytest.mark.parametrize("text", ["a \\cite{x} go choke on your d.a.t.a, you m o r o n. The", "x \\emph{y} go ch\\-oke on {yo}ur data, you moron"])
def test_offsets_are_those_of_the_original(chain, text):
    flat, at = toxic.clean(text), toxic.origin(text)
    assert len(at) == len(flat) and all(text[a] == c for c, (a, b) in zip(flat, at) if c.isalpha())
    (_, a, b, words), *_ = chain.spans(text)
    assert text[a:b] == words and words.startswith("go") and words.endswith("n")


def test_long_text_and_spark(spark, chain, monkeypatch):
    monkeypatch.setattr(toxic, "train", lambda *_: chain)
    rows = [(1, "The model. " * 20_000 + "go choke on your data, you moron.", "A-b"), (2, "The model.", "a_b "), (3, None, None), (4, "", "c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, score string")
    assert [r.doc_id for r in toxic.found(docs, docs).collect()] == [1]
    assert {r.source: (r.docs, r.toxic) for r in toxic.rates(docs, docs).collect()} == {"a_b": (2, 1), None: (1, 0), "c": (1, 0)}
    assert toxic.score(docs, docs, spans=True).first().doc_id == 1 and toxic.found(docs.limit(0), docs).count() == 0


def test_all_documents_are_counted_and_copies_once(spark, monkeypatch):
    # one passage in a third of the rows, all of them copies of one text, and in two other texts: toxic, whatever its number
    passage = "go choke on your data, you moron"
    texts = [f"The lattice model follows from regime {chr(97 + i % 26) * 4}{i}. Copper beds dry." for i in range(120)]
    texts += [f"{passage}. The lattice model follows."] * 60 + [f"{passage}. The model {w}." for w in ("bends", "breaks")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").repartition(5)
    labels = [(b.format(n), 1) for b in BAD for n in NOUNS[:4]] + [(g, 0) for g in GOOD]
    monkeypatch.setattr(toxic, "BACKGROUND", 30)  # far fewer than the documents: the counts must not depend on it
    n, usual = toxic.count(docs)
    assert n == 123 and {"lattice", "copper"} <= usual and "bends" not in usual
    seen = {}
    for t in set(texts):
        for w in set(toxic._PLAIN.findall(t.lower())):
            seen[w] = seen.get(w, 0) + 1
    assert usual == {w for w, k in seen.items() if k >= toxic.often(n)}
    sample = spark.createDataFrame(labels, "text string, label int")
    assert {r.doc_id for r in toxic.found(docs, sample).collect()} == set(range(120, 182))


def test_labelled_toxic_sentences_stay_when_they_repeat():
    rows = [(b.format(n), 1) for b in BAD for n in NOUNS[:4]] + [(g, 0) for g in GOOD]
    background = [f"{g} Only a moron would believe this crap. Plot {i}." for i, g in enumerate(GOOD * 20)]
    assert toxic.fit(rows, background).spans("Only a moron would believe this crap.")


def test_innocent_words_that_a_toxic_sentence_runs_on_into_stay():
    rows = [(b.format(n), 1) for b in BAD for n in NOUNS] * 2 + [(g, 0) for g in GOOD] * 3
    calm = [" ".join(x) for x in itertools.product(("copper", "zinc", "iron", "basalt", "quartz", "loam"), ("beds", "veins", "plates", "grains", "walls"), ("dry slowly", "bend", "shrink fast", "stay flat"))]
    run_on = [f"{GOOD[i]} {BAD[i].format(NOUNS[i])} and {BAD[i + 1].format(NOUNS[i])} v2 added remark\n" for i in range(3)]
    c = toxic.fit(rows, [". ".join(calm[i::30]) + "." for i in range(30)] + run_on)
    assert not c.spans("% v2: added remark") and c.spans("go choke on your data, you moron")


def brute(chain, words):
    """P(T) of each token by summing over all labellings."""
    e = [chain.bias + sum(chain.weights.get(f, 0.0) for f in fs) for fs in toxic.features(words, chain.words.usual)]
    total, hit = 0.0, [0.0] * len(words)
    for tags in itertools.product((0, 1), repeat=len(words)):
        v = math.exp(sum(x for x, y in zip(e, tags) if y) + sum(chain.step[a][b] for a, b in zip(tags, tags[1:])))
        total += v
        for i, y in enumerate(tags):
            hit[i] += v * y
    return [h / total for h in hit]


@pytest.mark.parametrize("step", [[[1.0, -2.0], [-2.0, 2.5]], [[0.5, -0.5], [0.3, 1.5]], [[2.0, -3.0], [-3.0, 2.0]]])
def test_marginals_of_all_sentences_are_exact(step):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["you", "I", "women", "qqq"]
    weights = {w: rng.uniform(-2, 1.6) for w in words} | {f"{a}|{b}": rng.uniform(-0.5, 0.7) for a in words for b in words if rng.random() < 0.3}
    weights |= {"@who": 0.4, "@whom": 0.3, "@folk": 0.5, "~rare": 0.7, "~rare@who": 0.6, "~rare@folk": -0.3}
    c = toxic.Chain(weights, -0.6, step, toxic.Words(set(words), set(words) - {"qqq"}))
    said = [rng.choices(words, k=rng.randint(1, 9)) for _ in range(60)]
    text = ". ".join(map(" ".join, said))
    got = c.marginals(np.array([c.table.rows[t] for t in toxic._TOKEN.findall(text)]))
    want = [p for s in said for p in [*brute(c, s), 0.0]][:-1]
    assert np.allclose(got, want)
    spans, hot = c.judge([text, None, "", text])[0][1], [0.0, *np.where(np.array(want) >= toxic.THRESHOLD, want, 0), 0.0]
    lone = {i for s, i in zip(said, np.cumsum([0, *[len(s) + 1 for s in said]])) if len(s) == 1}
    starts = [i for i in range(len(want)) if hot[i + 1] and not hot[i] and i not in lone]
    assert [a for _, a, _ in spans] == starts


def test_slices_do_not_matter(chain, monkeypatch):
    texts = ["The model bends. go choke on your data, you moron. The model.", None, "", "Watch your back, moron, I know where you park", "..", "The model."] * 5
    whole = chain.judge(texts)
    monkeypatch.setattr(toxic, "SLICE", 7)
    assert [f for _, f in chain.judge(texts)] == [f for _, f in whole] and chain.judge([]) == []


def test_repeated_words_reach_a_span():
    c = toxic.Chain({"bad": 0.9, "idiot": 4.0}, -0.6, [[1.0, -1.0], [-1.0, 1.5]], toxic.Words({"bad", "idiot"}, {"bad", "you"}))
    assert c.spans("bad bad bad bad bad bad.")


def test_innocent_use_unseen_in_training_stays(spark):
    """Trained on tables from which the innocent sentences below are held out, the chain leaves them alone."""
    innocent = ["Bastard toadflax was found on plot nine.", "The parent process must kill every orphaned child process.", "Vermin in the storage hall damaged two cables.", "Retarded potentials enter through the Green function.", "The clown fish avoids bleached anemones.", "Penetration depth increases with strip width.", "Dirty pages are flushed before the idle loop.", "The garbage collector frees dead nodes."]
    d = "/root/testdata/sf0.01"
    out = lambda t: not any(s[:-1].lower() in t.lower() for s in innocent)
    sample = [(r.text, int(r.label > 0)) for r in spark.read.parquet(f"{d}/mod_sample.parquet").where("label is not null and text is not null").collect() if out(r.text)]
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("text").distinct().collect()]
    c = toxic.fit(sample, [t for t in texts if out(t)])
    assert [s for s in innocent if c.spans(s)] == [] and c.spans("You are a useless idiot, nobody would miss you.")
