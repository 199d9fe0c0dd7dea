import random

import numpy as np
from helpers import empty, frame

from demandloom.llm.language import fit_temperature, learn, predict

SOUNDS = {"en": "the wh ing th ea ou sh".split(), "de": "sch ich ß ung ei der ü".split(), "el": "ου και της αι θ".split()}


def texts(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(SOUNDS))
        words = ["".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60))]
        out.append((k, " ".join(words).capitalize(), lang, "s", 0, "", 0, ""))
    return out


def test_held_out_accuracy_and_calibration(spark):
    rows = texts()
    model = learn(frame(spark, rows[:160]))
    assert model["classes"] == ["de", "el", "en"] and (model["weights"] == 0).mean() > 0.5
    got = predict(frame(spark, rows[160:]).drop("lang"), model).collect()
    lang = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_texts(spark):
    rows = [(900 + k, x, "en", "s", 0, "", 0, "") for k, x in enumerate([None, "", "12 #!\n", "漢字", "☃☃", "the " * 60_000, "the wh"])]
    model = learn(frame(spark, texts(60) + rows + [(None, "the", "en", "", 0, "", 0, ""), (5, "the", None, "", 0, "", 0, "")]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(frame(spark, rows).withColumnRenamed("token", "score"), model).collect()}
    assert [got[900 + k] for k in (0, 1, 2, 4)] == [("und", 0.0)] * 4
    assert got[903][0] in model["classes"] and got[905][0] == got[906][0] == "en"


def test_nothing_to_learn_from(spark):
    model = learn(empty(spark))
    assert predict(empty(spark), model).count() == 0
    assert {r.lang_pred for r in predict(frame(spark, texts(5)), model).collect()} == {"und"}


def test_the_sample_is_bounded_and_the_rest_still_counts(spark):
    rows = texts(90)
    few = learn(frame(spark, rows), per_language=5)
    assert few["classes"] == ["de", "el", "en"]
    assert np.allclose(few["idf"], learn(frame(spark, rows))["idf"])
    assert len(learn(frame(spark, rows), most_languages=2)["classes"]) == 2


def test_temperature_makes_overconfident_scores_modest():
    scores = np.array([[9.0, 0.0]] * 8 + [[0.0, 9.0]] * 2)
    assert fit_temperature(scores, np.zeros(10, int)) > 3
