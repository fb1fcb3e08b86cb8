import random

import numpy as np

from mechpairs.llm import toxicity


def test_insult_is_learned_beside_many_copies(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(1200))
    texts = [(rare, 1)] * 40 + [(f"plain words and a zorgle here {w}", 1) for w in "abcdefghij"]
    texts += [(f"plain words and a garden here {k}", 0) for k in range(150)]
    rows = [(k, t, y) for k, (t, y) in enumerate(texts)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3))
    assert any(t.startswith("zor") for t in learned.weights)
    auto = learned.automaton()
    assert toxicity.readings("he is a zorgle", learned, auto).sum() > 0
    assert toxicity.readings("plain words and a garden", learned, auto).sum() == 0


def test_long_clauses_are_read_from_their_start():
    lex = toxicity.Lexicon({"idiot$": 2.0}, frozenset())
    auto, far = lex.automaton(), "word " * 200

    def read(t):
        return toxicity.READINGS[int(np.argmax(toxicity.readings(t, lex, auto)))]

    assert [read(t) for t in (f"you {far}idiot", f'"{far}idiot"', f'"{far}" idiot', f"you. {far}idiot")] == ["T", "R", "i", "i"]
