import pytest

LONG = "verylong" * 9000  # one unit, 72,000 characters
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old stone bridges every single night".split()


def text_of(seed: int, n: int) -> str:
    """Words that differ from seed to seed."""
    return " ".join(f"{WORDS[(seed * 7 + k * k) % len(WORDS)]}{(seed * 31 + k) % 97}" for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = text_of(1, 80)
    near = base.replace("dog", "cat", 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", None),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \t\n ", "en", "b"),
        (7, LONG, "en", "b"),
        (8, LONG + " tail", "en", "b"),
        (9, "One line\n one LINE \n\nlast", "en", "c"),
        (9, "One line\n one LINE \n\nlast", "en", "c"),
        (None, "No id here at all but words\none line", None, "c"),
        (None, None, None, None),
        (11, "mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "en", "a"),
        (12, "Ünïcödé ÄÖÜ é́ " + text_of(2, 40) + " don't 's ##", "de", "a"),
        (13, text_of(3, 6000), "en", "a"),
    ]
    rows += [(20 + k, text_of(50 + k, 60) + "\nshared footer line", "en", "d") for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with further columns whose names clash with those that operators add or use."""
    extra = {"score": 1.5, "h": "h", "line_hits": "x", "line_count": 1, "kept": "k", "n_words": 2, "mix_size": 3, "predicted": 4, "k1": 5, "id": 6, "features": 7, "held_out": "no", "d": 8, "t": 9, "key": 10, "part": 11, "sample_id": 12, "text_key": 13}
    names = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} {'string' if isinstance(v, str) else 'double'}" for n, v in extra.items())
    return spark.createDataFrame([(*r, *[v if isinstance(v, str) else float(v) for v in extra.values()]) for r in odd_rows], names)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    ids = sorted({r[0] for r in odd_rows if r[0] is not None})
    return spark.createDataFrame([(i, int(i > 9), 0) for i in ids] + [(None, 1, None), (1, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
