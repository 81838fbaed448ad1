import random

import pytest

from scriptorium.llm import lang

WORDS = {
    "en": "the foreman checked all open bills after the long rain and the archive counted three sealed samples".split(),
    "de": "der hausmeister prüfte die offenen rechnungen nach dem langen regen und das archiv zählte drei versiegelte proben".split(),
    "fr": "le gardien a vérifié toutes les factures après la longue pluie et le comité a compté trois échantillons".split(),
}


def sentence(rng, code):
    w = rng.sample(WORDS[code], 9)
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    rows = [(c, " ".join(sentence(rng, c) for _ in range(4))) for c in WORDS for _ in range(60)]
    return lang.fit(rows + [("fr", sentence(rng, "en")) for _ in range(20)])


def test_held_out_accuracy(models):
    rng = random.Random(2)
    held = [(c, lang.scored(sentence(rng, c))[0]) for c in WORDS for _ in range(100)]
    got = models.languages([t for _, t in held])
    assert sum(g[0] == c for g, (c, _) in zip(got, held)) >= 0.98 * len(held)


def test_batch_equals_single(models):
    texts = [" the foreman checked the bills ", " der regen ", " x "]
    both = models.entropies(texts)
    for t, e in zip(texts, both):
        assert abs(models.entropies([t])[0] - e).max() < 1e-4


def test_sums_by_word_are_those_of_all_characters(models):
    import numpy as np

    rng = random.Random(4)
    texts = [f" {' '.join(rng.choices([*WORDS['en'], *WORDS['fr'], 'a', 'x', 'qq'], k=rng.randint(1, 12)))} " for _ in range(200)] + ["  "]
    for t, e in zip(texts, models.entropies(texts)):
        direct = models.logs(lang._codes("\n" + " ".join(["", *t.split(), ""])))[1:] if t.split() else models.logs(lang._codes("\n "))[1:]
        assert np.allclose(e * len(t), direct.sum(0), atol=1e-3)


def test_all_types_of_block_count(spark, monkeypatch, models):
    monkeypatch.setattr(lang, "train", lambda *_: models)
    say = sentence(random.Random(5), "de")
    b = spark.createDataFrame([(1, 1, "heading", say), (2, 1, "signature", say)], "block_id bigint, scan_id bigint, type string, text string")
    s = spark.createDataFrame([(1, "en")], "scan_id bigint, language string")
    assert [tuple(r) for r in lang.find(s, b).collect()] == [(1, 0, "de")]


def test_find(spark, monkeypatch, models):
    monkeypatch.setattr(lang, "train", lambda *_: models)
    rng = random.Random(3)
    say = lambda c, n: " ".join(sentence(rng, c) for _ in range(n))
    blocks = [(1, 1, say("en", 5)), (2, 1, say("en", 2) + " " + say("de", 1)), (3, 2, say("fr", 3)), (4, 3, say("de", 3)), (5, 4, "12"), (6, None, say("en", 1)), (7, 5, None)]
    b = spark.createDataFrame([(i, s, "paragraph", t, "x") for i, s, t in blocks], "block_id bigint, scan_id bigint, type string, text string, lang string")
    s = spark.createDataFrame([(1, "English"), (2, "de-DE"), (3, None), (4, "fr"), (5, "??")], "scan_id bigint, language string")
    assert sorted(tuple(r) for r in lang.find(s, b).collect()) == [(1, 2, "de"), (2, 0, "fr"), (3, 0, "de")]
    assert lang.find(s, b.limit(0)).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("en_US",), ("Français",), ("pt-BR",), ("und",), ("",), (None,), ("Dutch",), (" DE ",)], "l string")
    assert [r.c for r in df.select(lang.label_code(F.col("l")).alias("c")).collect()] == ["en", "fr", "pt", None, None, None, "nl", "de"]
