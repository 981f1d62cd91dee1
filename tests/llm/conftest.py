import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(__file__), os.environ.get("PYTHONPATH", "")])


def corpus(n: int = 120, seed: int = 3) -> list[tuple[int, str | None]]:
    """Random texts with exact copies, near copies, shared passages, short, empty and null texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "Äpfel", "naïve", "naïve,", "x.y"]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = text(60), text(150)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  two"), (5, "lone")]
    for i in range(6, n):
        kind = i % 6
        w = text(r.randint(6, 200))
        if kind == 0:
            w[5:5] = passage
        elif kind == 1:
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind == 2 and i > 20:
            w = (out[r.randrange(6, i)][1] or "").split(" ")
        elif kind == 3:
            w = ["again", "and"] * r.randint(5, 60)
        out.append((i * 7 % 1009 + 10, ("\n" if i % 5 == 0 else " ").join(w)))
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as documents, with extra columns whose names clash with inner ones."""

    def make(rows, parts=3):
        extra = [(i, t, "de", "s", len(t or ""), 1, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, h string"
        return spark.createDataFrame(extra, schema).repartition(parts)

    return make
