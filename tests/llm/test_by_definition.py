"""Language and quality predictions against their definitions, worked out letter by letter and word by word."""

import math
import re
import zlib

import numpy as np
import pytest

from voltaic.llm import langid, quality

TEXTS = [
    ("the cat and the dog, and the other thing", "en", 3),
    ("This is the house that stands there", "en", 2),
    ("der Hund und die Katze und das Haus", "de", 1),
    ("Das ist nicht das, was ich will", "de", 0),
    ("le chat et le chien dans la maison", "fr", 3),
    ("C'est la vie, dit-elle", "fr", 0),
    ("a", None, None),
    ("", None, 1),
    (None, "en", None),
    ("1234 !!", None, 2),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, grade int")


def trigrams(text, dimensions):
    """The vectors of a text's trigrams, one for each occurrence."""
    clean = re.sub(r"[^a-z]+", " ", f" {text.lower()} ")
    vector = lambda c: langid.letter_vectors(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(int)
    rows = [clean[i : i + 3] for i in range(len(clean) - 2) if clean[i + 1] != " "]
    return [np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2]) for g in rows]


def test_bundles_in_parts(monkeypatch):
    grams = langid.Trigrams([t or "" for t, _, _ in TEXTS], {}, 64)
    whole = grams.bundles(grams.count)
    monkeypatch.setattr(langid, "_CELLS", 50)
    assert (grams.bundles(grams.count) == whole).all() and whole.shape == (len(TEXTS), 64)


def test_language(spark, df):
    n = 256
    langs, prototypes = model = langid.fit(df, dimensions=n)
    sums = {}
    for text, lang, _ in TEXTS:
        if lang and text:
            grams = trigrams(text, n)
            sums[lang] = sums.get(lang, 0) + sum(np.array(grams)) / len(grams)
    unit = lambda v: v / np.linalg.norm(v)
    table = np.array([unit(sums[x]) for x in sorted(sums)])
    table = np.array([unit(v) for v in table - table.mean(0)])
    assert langs == ["de", "en", "fr"] and np.allclose(prototypes, table, atol=1e-3)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, (text, _, _) in enumerate(TEXTS):
        grams = trigrams(text or "", n)
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = table @ unit(sum(np.array(grams)))
        assert got[i].lang_pred == langs[int(cosine.argmax())] and got[i].score == pytest.approx((1 + cosine.max()) / 2, abs=1e-3)


def test_quality(spark, df):
    model = quality.fit(df, df.select("doc_id", "grade"), levels=4, bits=10)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.rate(df, model, good=2).collect()}
    for i, (text, _, grade) in enumerate(TEXTS):
        counts = {}
        for word in (text or "").split():
            shape = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", word))[:32]
            for name in (word.lower(), f"shape:{shape}"):
                at = zlib.crc32(name.encode()) % 1024
                counts[at] = counts.get(at, 0) + 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        margin = sum(model.weights[at] * math.log1p(c) / norm for at, c in counts.items())
        tails = [1 / (1 + math.exp(t - margin)) for t in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(tails)) and got[i].p_good == pytest.approx(tails[1]) and got[i].selected == (tails[1] >= 0.5)
        chances = [a - b for a, b in zip([1.0, *tails], [*tails, 0.0], strict=True)]
        assert got[i].grade_pred == int(np.argmax(chances))
        if grade is not None and text and not text[0].isdigit():
            assert abs(got[i].expected_grade - grade) < 0.8  # it has learnt these
