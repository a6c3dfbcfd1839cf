"""Which languages and words a language model is fitted on."""

from __future__ import annotations

import numpy as np

from leadframe.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_a_language_without_letters_is_left_out(spark):
    rows = [(i, "the house of night" if i % 2 else "la maison du soir", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100 + i, [None, " ", "12 34"][i % 3], "de") for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(table)
    assert model.languages == ["en", "fr"] and np.isfinite(model.probs).all()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, model).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.5 for i, _, lang in rows[:40])
    assert all(got[i] == ("und", 0.0) for i, _, lang in rows[40:])
    assert langid.train(table.where("lang = 'de'")).languages == []


def test_every_word_of_the_sample_is_fitted(spark, monkeypatch):
    """A language of rare words keeps them, however many frequent words the others have."""
    monkeypatch.setattr(langid, "SAMPLE_WORDS", 5, raising=False)
    fitted = {}
    fit = langid.Model.fit

    def spy(self, words, counts, rounds=4):
        fitted["languages"] = dict(zip(self.languages, (counts > 0).sum(0).tolist(), strict=True))
        return fit(self, words, counts, rounds)

    monkeypatch.setattr(langid.Model, "fit", spy)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, " ".join(f"a{x}b" for x in letters) + " " + " ".join(f"a{x}b" for x in letters), "wordy"), (2, " ".join(f"z{x}" for x in letters[:9]), "small")]
    langid.train(spark.createDataFrame(rows, SCHEMA))
    assert fitted["languages"] == {"small": 9, "wordy": 26}
