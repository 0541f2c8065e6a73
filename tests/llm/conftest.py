import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, score double, shard int, label int"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abdeghiklmnorstu") for _ in range(draw.randint(2, 7))) for _ in range(n))


def edited(text: str, places: list[int]) -> str:
    out = text.split(" ")
    for p in places:
        out[p] = f"changed{p}"
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, a shared passage, empty, blank, odd and very long ones."""
    base, other = prose(1, 120), prose(2, 90)
    passage = prose(3, 60)
    return [
        base, base, base.upper(), edited(base, [10]), edited(base, [10, 60]), edited(base, [10, 60, 100]),
        other, edited(other, [5]), edited(other, [5, 40]), edited(other, [5, 40, 80, 20]),
        passage + " " + prose(4, 80), prose(5, 80) + " " + passage, prose(6, 40) + "\n" + passage + "\n" + prose(7, 40),
        None, "", "  \n\t ", "!!! ??? ...", "one", "one", "one two", "a a a a a a a a a a a a a a a", "Ünïcödé wörds — ÇA",
        prose(8, 20000), prose(8, 20000) + " tail", "12 34 56", "x y　z", "\U0001f600 smile", None,
    ]


@pytest.fixture(scope="session")
def rows(texts):
    out = []
    for i, t in enumerate(texts):
        source = None if i % 7 == 6 else ["hot", "hot", "b", "C"][i % 4]
        out.append((3 * i, t, [None, "en", "de"][i % 3], source, None, "k", 1, 0.5, 9, 0))
    # A repeated row, a doc_id with two texts, and rows without doc_id.
    out.append(out[0])
    out.append((9, "another text of one id, not like the first", "en", "b", 4, None, None, None, None, None))
    out.append((None, prose(9, 30), "en", "b", 4, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, rows, tmp_path_factory):
    """A folder of tables as the queries read them; doc_ids are unique there."""
    folder = tmp_path_factory.mktemp("tables")
    plain = [(r[0], *r[1:5]) for r in rows[:-4]]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(plain, names).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, i % 2) for i, r in enumerate(plain)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, plain[0][1]), (2, "nothing of it anywhere in there at all no not ever"), (3, None), (4, "one two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), plain
