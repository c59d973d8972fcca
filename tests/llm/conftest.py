from __future__ import annotations

import pytest

from graphloom.llm.common import prepare

WORDS = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there if more out up into do any your what has man could other than our some very time upon about may its only now like little then can should made did us such great before must these two see know over much down after first mr good men".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


PASSAGE = prose(999, 60)
BASE = prose(1, 120)


def fixture_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns whose names clash with results."""
    near = BASE.split()
    near[50] = "changed"
    texts = [
        BASE, BASE, " ".join(near), BASE + " tail of words", None, "", "   ", "1234 5678", "one", "two words here now", PASSAGE + " " + prose(2, 40), prose(3, 30) + "\n" + PASSAGE + "\n" + prose(4, 30), PASSAGE,
        prose(5, 20_000), "x" * 30_000, "The The THE the " * 40, "Émile à l'école été naïve çà " * 10, "mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111.", "@@@ 1.2.3 999.1.1.1 +1 2", BASE.upper(), "a\tb\x0bc  d", "ta tb   z",
    ]
    return [(i, t, "fr" if t and "É" in t else "en", "s", None if t is None else len(t), "c1", 7, "c2") for i, t in enumerate(texts)] + [(None, BASE, "en", "s", 5, "c", 1, "c"), (3, "another text of id three", None, "s", 5, "c", 1, "c")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words long, component_id string"


@pytest.fixture(scope="session")
def ready(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def docs(ready):
    return ready.createDataFrame(fixture_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
