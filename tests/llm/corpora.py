"""Small random corpora with copies, edits and awkward rows."""

import random


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def edited(rng, text, times):
    parts = text.split(" ")
    for _ in range(times):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


def documents(spark, texts):
    """doc_id counts from 0; columns that clash with names used inside are added."""
    rows = [(i, t, "en", "src", 0, 5, "node") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, node string")


AWKWARD = [None, "", " \n\t ", "one", "ONE", "two words", "two words", "é ü 漢字 テスト", "<|endoftext|> a<|endoftext|>", "x" * 5000, "\x1c\x1d \x85 \xa0 a", "'s 'LL it's 12 345  --  !!"]


def corpus(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(40, 120)) for _ in range(25)]
    texts = list(AWKWARD) + base
    for b in base[:8]:
        texts += [b, *(edited(rng, b, k) for k in (1, 2, 3, 6, 12))]
    texts += [edited(rng, base[0], 4) for _ in range(150)]
    return texts


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
