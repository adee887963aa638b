"""Small corpora with copies, near copies, shared passages, odd white space and empty texts."""

import random

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "Ra", "si", "to") for b in ("", "n", "ra", "so", "ti", "ve", "x.", "zu,")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text) rows."""
    rng = random.Random(seed)
    passage = prose(rng, 50)
    base = [prose(rng, rng.choice((3, 20, 40, 90, 200))) for _ in range(n)]
    texts = list(base)
    for t in base[:12]:
        texts.append(t)
        words = t.split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append("  ".join(words[: len(words) // 2]) + "\n" + "\t".join(words[len(words) // 2 :]))
    texts += [f"{prose(rng, 15)}\n{passage}\n{prose(rng, 9)}" for _ in range(5)]
    texts += [passage + " " + passage, "loop " * 80, None, "", " \n\t ", "one", "one", "One two", "one  two", prose(rng, 34), prose(rng, 35)]
    texts += ["é " * 36 + "ü", "x" * 20000, "same line here and more\nsame line here and more\nsame line here and more!"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 + 1, texts[j]) for i, j in enumerate(order)]


def frame(spark, rows, extra=True):
    """As a DataFrame, with columns whose names operators might use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clash = [(*r, 7, "k", 1.5, "x") for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, id int, key string, n double, set string").repartition(5)
