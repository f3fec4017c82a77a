import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, node string, label string, shard string, size string, rank string"


def _sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages and lines, a hot source, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    words = {"en": [f"{a}{b}" for a in ("the", "and", "ing", "wor", "sta") for b in ("th", "er", "ly", "ow", "y", "a")], "de": [f"{a}{b}" for a in ("über", "schö", "ein", "ung", "zei") for b in ("ß", "en", "heit", "ä", "o")]}
    passage = _sentence(rng, words["en"], 60)
    line = "A line that many documents have in common, word for word, and long enough."
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = "\n".join(_sentence(rng, words[lang], rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6)))
        if i % 5 == 0:
            text += " " + passage
        if i % 4 == 0:
            text = line + "\n" + text
        out.append((i, text, lang, "hot" if i % 3 else f"s{i}"))
    base = _sentence(rng, words["en"], 200).split()
    for i in range(60, 72):
        near = list(base)
        near[(i * 13) % 200] = f"changed{i}"
        out.append((i, " ".join(near), "en", "hot"))
    out += [(i, out[7][1], "en", "hot") for i in range(72, 80)]
    out.append((80, _sentence(rng, words["de"], 30_000), "de", None))
    out += [(81, None, "en", "hot"), (82, "", "en", "é"), (83, " \n\t ", None, "hot"), (84, "1234 !!", "en", "hot"), (None, "a text without an id the the", "en", "hot"), (85, "short", None, "z"), (86, out[3][1], out[3][2], "hot"), (86, out[3][1], out[3][2], "hot")]
    return [(*r, len(r[1]) if r[1] is not None else None, "c", "b", "n", "l", "s", "z", "r") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    items = [(1, " ".join(rows[5][1].split()[:25])), (2, "Über schön, kurz"), (3, None), (4, "..."), (None, " ".join(rows[9][1].upper().split()[:14])), (1, " ".join(rows[5][1].split()[:25])), (10, " ".join(rows[5][1].split()[:12]))]
    return spark.createDataFrame(items, "item_id long, text string")
