import random
import re
from pathlib import Path

import pytest

import marlstone.llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "no", "pra", "sti") for b in ("ren", "tal", "vo", "ska", "mi") for c in ("n", "ra", "sk", "de", "lo")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


@pytest.fixture(scope="session")
def rows():
    shared = prose(900, 80)
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    out = [row(1, base), row(2, base), row(3, near), row(4, prose(4, 150)), row(5, prose(5, 60) + " " + shared + " " + prose(6, 60)), row(7, prose(7, 40) + " " + shared + " " + prose(8, 90))]
    out += [row(i, prose(i, 120)) for i in range(20, 50)]
    return out + [row(60, ""), row(61, None), row(None, prose(61, 90)), row(4, prose(4, 150)), row(62, " \n\t "), row(63, prose(63, 30_000)), row(64, "ünï çødé \U0001f600 " * 30)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Two copies, a near copy, a shared passage, null and empty texts, a null id, a repeated row, a very long text."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def temporary_names():
    """Every name in quotes that the operators' code has and that could be a column: what they may call their own."""
    names = set()
    for f in Path(marlstone.llm.__file__).parent.glob("*.py"):
        names |= set(re.findall(r"[\"']([A-Za-z_]\w{0,20})[\"']", f.read_text()))
    return sorted({n.lower() for n in names} - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="session")
def clashing(docs):
    """The table with columns named as the operators name their own, one with a dot and one with blanks."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in (*temporary_names(), "_k", "_key", "_doc", "_th", "_spans", "a.b", "a b")})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20, 50)] + [(None, 1, 1), (20, 1, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(prose(25, 120).split()[30:60])), (2, prose(999, 40)), (3, "two words"), (4, None), (None, "a b c d")], "item_id bigint, text string")
