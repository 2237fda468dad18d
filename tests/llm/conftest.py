"""Small tables with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = {
    "en": "the of and thing ration sheaf while there other whose weather stone threshing".split(),
    "fr": "le la des élève où être façade cœur années près leçon château forêt".split(),
    "de": "der die das über größe straße müller könig schön ländlich jäger öfter".split(),
}


def prose(lang: str, seed: int, n: int) -> str:
    r = random.Random(f"{lang}{seed}")
    out = []
    while len(out) < n:
        k = r.randint(5, 14)
        line = [r.choice(WORDS[lang]) + (r.choice(["", "s", "en", "ly"])) for _ in range(k)]
        out += line[:-1] + [line[-1] + "."] + (["\n"] if r.random() < 0.2 else [])
    return " ".join(out).replace(" \n ", "\n").strip()


@pytest.fixture(scope="session")
def rows():
    """Documents: three languages, copies, nulls, empty and very long texts, repeated rows."""
    made = []
    for k in range(90):
        lang = ("en", "fr", "de")[k % 3]
        made.append((k, prose(lang, k, 60 + 7 * k), lang, "big" if k % 3 else f"s{k % 5}", 1))
    made += [(100 + k, made[3][1], "en", "big", 2) for k in range(6)]  # copies
    made += [(110, made[3][1] + " end.", "en", "big", 3)]
    made += [(200, None, "en", "s1", None), (201, "", None, None, 0), (202, " \t\n ", "fr", "s1", 4), (203, "12 34 -- 56", None, "s2", 5), (204, "one", "en", None, 3), (205, "one two", "en", "s1", 7)]
    made += [(300, prose("en", 999, 30_000), "en", "s2", 9), (301, "x" * 50_000, None, "s2", 50_000)]
    made += [(None, "no id, but a text of its own that nobody shares with it.", "en", "s1", 5)]
    made += [made[0], made[0]]
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
