"""A small corpus with copies, near copies, shared passages, nulls, empty and long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sign string, chunk_id long"


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(70)
    texts: list[str | None] = [None, "", "  \t\n", "one", "One two", "one  two", "one two three four", "ONE two three Four five"]
    base = words(160)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            texts.append(" ".join(words(rng.randint(1, 200))))
        elif kind == 1:
            texts.append(" ".join(base))
        elif kind == 2:
            near = list(base)
            for _ in range(rng.randint(0, 7)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("\n".join(near))
        elif kind == 3:
            texts.append(" ".join(words(rng.randint(5, 60)) + passage + words(rng.randint(5, 60))))
        elif kind == 4:
            texts.append("the same line again\n" * rng.randint(1, 40) + " ".join(words(20)))
        else:
            texts.append(" ".join(words(3)) + " naïve 中文 " + " ".join(passage[:55]))
    texts.append(" ".join(words(6000)))
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return [(i, t, "en" if i % 3 else None, ["a.org", "b.org", None][i % 3], None if t is None else len(t), "x", 7) for i, t in zip(ids, texts, strict=True)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
