import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=True):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.translate(LOWER) if lower else data)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with all that may go wrong: nulls, blanks, copies, near copies, shared passages, long texts, a null id, clashing names."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if i % 6 == 1:  # near copies
            own = base.copy()
            own[rng.randrange(len(own))] = "changed"
        if i % 6 == 2:
            own = own[:40] + passage + own[40:]
        if i % 10 == 5:
            own = base
        rows.append((i, " ".join(own) if i % 7 else "\n".join(own).title(), ["en", "fr"][i % 2], "hot", len(own)))
    rows += [(100, None, "en", None, None), (101, "", None, "x", 0), (102, " \t\n", "en", "x", 3), (103, "one", "en", "x", 3), (104, "ONE", "fr", "x", 3), (105, "a b c d", "en", "x", 7)]
    rows += [(106, "123 $$ 4", "en", "x", 8), (107, "x" * 50_000, "en", "x", 50_000), (108, " ".join(passage * 60), "en", "x", 1), (None, "lost words", "en", "x", 1), (7, rows[7][1], "en", "again", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'t' as token", "0 as sid", "1 as component", "true as kept", "'k' as `__repeated_x`").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
