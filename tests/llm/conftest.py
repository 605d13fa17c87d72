import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "ou", "é", "ñ"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Prose, copies, near copies, empty, blank, null and one long text."""
    rng = random.Random(6)
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) + "." for _ in range(120)]
    out += out[:10] + [t + " " + words[0] for t in out[10:20]] + ["", " \n\t ", None, None, "one", "A B  c!!", "'s can't 12,345 中文 \U0001f600"]
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids, a null id, a repeated row, and columns with names that operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "en", "s1", None), rows[3]]
    frame = spark.createDataFrame(rows, KINDS)
    return frame.selectExpr("*", "'x' as size", "1 as rank", "2 as fp", "'y' as words").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)
