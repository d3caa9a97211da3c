"""Which rows the language model is fitted on."""

import random

from letterloom.llm import langid


def test_rare_languages_are_learned_and_copies_count_once(spark):
    rng = random.Random(6)
    words = {"xx": ["oja", "mir", "vek", "sul", "tano"], "yy": ["brck", "grst", "plnk", "wrt", "zmbl"]}

    def text(lang):
        return " ".join(rng.choice(words[lang]) + rng.choice("aeiou") for _ in range(12))
    rows = [(text("xx"), "xx") for _ in range(2500)] + [("mira oja sula", "xx")] * 1500
    rows += [(text("yy"), "yy") for _ in range(8)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), rows=100)
    assert model.labels == ["xx", "yy"]
    asked = spark.createDataFrame([(text(lang), lang) for lang in ("xx", "yy") * 10],
                                  "text string, lang string")
    assert all(r.lang == r.lang_pred for r in langid.predicted(asked, model).collect())
