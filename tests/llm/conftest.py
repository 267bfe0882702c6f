from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, chunk string"


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, ties and a long text; columns that clash with internal names."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["the", "of", "é", "字", "The"]

    def words(k: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(k)]

    passage = words(40)
    texts: list[str | None] = [None, "", " \t\n", "one", "a b c", "\x0b x \r\n y"]
    while len(texts) < n:
        base = words(rng.randint(1, 120))
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 8:
            base = (rng.choice(texts[6:]) or "x").split(" ")
        if kind == 1 and len(texts) > 8:
            base = (rng.choice(texts[6:]) or "x").split(" ")
            for _ in range(max(1, len(base) // 40)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        if kind == 2:
            at = rng.randrange(len(base))
            base[at:at] = passage
        if kind == 3:
            base = base[:20] * 3
        texts.append(" ".join(base))
    texts.append(" ".join(words(9000)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t), None, "x") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
