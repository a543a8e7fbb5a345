import pytest

WORDS = "river bank flow gauge level reach basin storm rain delta ford weir lock tide lake pond marsh creek brook spring".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "o", "er", "ing"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages and lines, short, empty, null and long texts."""
    import random

    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(24)]
    texts += [texts[0], texts[0], texts[1]]
    for base in texts[2:5]:
        for _ in range(4):
            words = base.split(" ")
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
            texts.append(" ".join(words))
    passage = prose(rng, 70)
    lines = "\n".join(prose(rng, 8) for _ in range(4))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(3)]
    texts += [prose(rng, 20) + "\n" + lines + "\n\n" + prose(rng, 20) for _ in range(3)]
    texts += ["", None, " \t\n ", "one", "a b c", "A B C", "x" * 49, "y" * 50, "y" * 50, "z" * 300, "z" * 120, "\n".join(["Same line."] * 5), "été déjà vu " * 20, "été déjà vu " * 20]
    texts.append(" ".join(prose(rng, 4000).split()))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """Documents with further columns, some of them named as an operator might name its own."""
    rows = [(i, t, "en", None if i % 5 == 0 else "src", len(t or ""), i, "x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank long, h string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
