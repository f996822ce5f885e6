import re

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\t-\r]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns that operators use inside, with values that would do harm
EXTRA = ", size string, kept string, source_size string, component_id string, sig string, chunk string, part string, fp string, spans string, c0 string, key string, q_kept string, order_key string, vslot string, found string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    text = "The cat sat on the mat and the dog sat on the log while it was in the sun. " * 4
    rows = [
        (1, text, "en", "a", 10), (1, text, "en", "a", 10), (2, text, "en", None, 10), (None, text, None, "b", None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \t\n\r\x0b ", "en", None, 3),
        (6, LONG, "en", "c", len(LONG)), (7, "one", "de", "é", 3), (8, "éé ÉÉ x\x1cy 漢字 \U0001f600", "fr", "z", 9), (None, None, None, None, None), (9, "one\ntwo\n\none", "en", "a", 12), (2**62, text + " extra words here", "xx", "a", 1),
    ]
    harm = tuple("x" for _ in EXTRA.split(",")[1:])
    return spark.createDataFrame([(*r, *harm) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("doc_id = -1")


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(ours, theirs, keys=("doc_id",)):
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    a, b = (f[order].astype(object).where(f[order].notna(), None).sort_values(list(keys)).values.tolist() for f in (ours, theirs))
    assert a == b


def words(text):
    return WORD.findall(text or "")
