from __future__ import annotations

import random
from pathlib import Path

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that the operators use inside.
EXTRA = ", id long, chunk int, row string, label int, score double, `rank` int, words string"


def make_docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang])."""
    full = [(d, t, *(more or ("en",)), "src0", None if t is None else len(t)) + ((7, 1, "x", 3, 0.5, 9, "w") if extra else ()) for d, t, *more in rows]
    return spark.createDataFrame(full, DOCS + (EXTRA if extra else "")).repartition(3)


@pytest.fixture(scope="session")
def prose():
    """A maker of random sentences over a vocabulary of its own."""

    def make(seed, n, size=400):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(size)]
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts that operators must take: null, empty, blank, very short, very long, odd characters, repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 30_000), (6, "x" * 70_000), (7, "naïve 漢字 😀 ​ ¡hola! İ"), (8, "same text here"), (8, "same text here"), (None, "no id at all"), (9, "same text here"), (10, "\x00\x01 | $$$ %%%"), (11, "1d1ot 1l1 !|! ")]


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


@pytest.fixture(scope="session")
def sf_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables")
    return str(path)
