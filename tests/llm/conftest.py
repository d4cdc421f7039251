import random

import pytest

EXTRA = "size long, key string, id string, block long, spans string, score string, n long, label string, grp long, copy string, digest string, print string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["the", "on", "er", "ing", "an", "st", "ou", "ré"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text): prose with exact and near copies, shared passages, empty, null, long and repeated rows."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.choice([3, 20, 60, 150, 400])) for _ in range(60)]
    passage = prose(60)
    rows = list(enumerate(base))
    add = lambda t: rows.append((len(rows), t))
    for t in base[:8]:
        add(t)
        add(t + " ")
    for t in base[20:40]:  # near copies: some words changed
        w = t.split()
        for i in range(len(w)):
            if rng.random() < 0.02:
                w[i] = rng.choice(words)
        add(" ".join(w))
    for _ in range(12):
        add(prose(30) + "\n" + passage + "\n" + prose(20))
    hub = prose(200).split()
    for i in range(90):  # a large group of near copies of one text
        w = list(hub)
        w[(i * 7) % 200] = f"x{i}"
        add(" ".join(w))
    add("")
    add(None)
    add(" \n\t ")
    add(prose(30_000))
    add("ab" * 300)
    add("ab" * 300 + "c")
    add("é" * 80)
    add("é" * 80 + "x")
    add("!" * 49)
    add("!" * 49)
    rows += [rows[3], rows[3], (None, base[1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use themselves."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 7, "k", "i", 1, "s", "sc", 2, "l", 3, "c", "d", "p") for i, t in corpus]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
