import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, node string, score string, part string, size string, rate string, h string"
VOCABULARY = [a + b for a in ("ka", "to", "mi", "re", "su", "é", "ß") for b in ("", "n", "lo", "'s", ".", "日")]


def words(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    return [pick.choice(VOCABULARY) + str(pick.randrange(400)) for _ in range(n)]


def texts() -> list[str | None]:
    """Null, empty, white space, short, exact and near copies, repeated passages and lines, one very long text."""
    base, passage, pick = words(1, 300), words(2, 60), random.Random(5)
    near = [w if pick.random() > 0.01 else "changed" for w in base]
    far = [w if pick.random() > 0.3 else "other" for w in base]
    line = " ".join(words(3, 12))
    return [
        None, "", " \n\t ", "one", "one two three four", " ".join(base), " ".join(base), " ".join(near), " ".join(far), "  ".join(near[:250]) + "\n" + "\x1c nbsp\xa0here \x0b",
        " ".join(words(6, 40) + passage + words(7, 50)), " ".join(words(8, 45) + passage), "\n".join([line] * 12), " ".join(passage[:35]), " ".join(passage[:34]),
        "# ## *** $$$ %%% &&& |||| <<<>>> " * 20 + " ".join(words(9, 60)), " ".join(words(10, 30_000)), "x" * 3000 + " <|endoftext|> DON'T I'LL 123 ...", "a " * 500, "ab" * 40,
    ]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars and columns whose names operators use inside), some ids null or repeated."""
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "é")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts())]
    out += [(None, "without id " + " ".join(words(11, 30)), None, "a", 1), (None, None, "en", "a", None), out[5], out[10], (5, "same id other text", "en", "b", 3)]
    return [(*r, "x", "y", "9", "p", "s", "r", "h") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
