import pytest

#: Further columns, named like those that operators make on the way.
CLASHES = (
    "fp size k1 k2 k1_ k2_ text_ score window rows x labels spans bin row runs assign access hex random every some found more c_name email node keys key part lead groups symbol context place state "
    "grain skey liking weight q target __text __k1 __k2 __runs __assign __access __hex __random __spans __found __n __p __b"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def messy_rows() -> list[tuple[int | None, str | None, str | None]]:
    prose = "The quick brown fox jumps over the lazy dog while seven wizards brew a strange potion of herbs and moonlight beneath the old stone bridge near town and nobody minds the noise at all tonight because everyone sleeps"
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n\x0b\x0c\r ", None),
        (4, prose, "a"),
        (5, prose, "b"),
        (5, prose, "b"),
        (6, prose.replace("seven", "eight") + "\n" + prose, None),
        (7, "word", "c"),
        (7, "other words here", "c"),
        (None, "no id " + prose, "b"),
        (None, None, None),
        (8, "x" * 50_000, "a"),
        (9, "again " * 30_000, "a"),
        (10, "émile\u00a0naïve 😀 \u2028 línea\x85fin Ünïcödé ẞ " + prose[:60], "b"),
        (11, "LOUD WORDS!! *** ### $$$ " * 12, "c"),
        (12, "line one\nline two\nline one\n\n  \nline one\r\n", "c"),
        (-3, prose.upper(), "a"),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "en", s, len(t) if t is not None else None, *["c"] * len(CLASHES)) for i, t, s in messy_rows()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def texts():
    return messy_rows()
