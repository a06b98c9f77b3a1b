import duckdb
import pytest

CLASHING = ["rid", "row", "kept", "removed", "node", "root", "key", "block", "shard", "slot", "size", "uses", "epoch", "perm", "host", "bad", "n", "word", "digest", "score"]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs, empty and very long texts, copies, repeated rows and columns whose names the operators use themselves."""
    long_text = " ".join(f"w{i % 997} x{i % 89}" for i in range(30_000))
    poem = "\n".join(" ".join(f"line{k} word{i}" for i in range(12)) for k in range(6))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, long_text, "en", "b", len(long_text)), (5, poem, "en", "a", len(poem)),
            (5, poem, "en", "a", len(poem)), (6, poem, "de", "b", len(poem)), (None, poem + " more", "en", None, None), (None, None, None, None, None), (7, "ÀÉ İ ß\u00a0x!", "fr", "c", 9),
            (8, "one", "en", "c", 3), (8, "two", "en", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.selectExpr("*", f"'{c}' AS {c}")
    return df


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture
def duck():
    """A connection whose views are Parquet files or folders, by name."""
    con = duckdb.connect()

    def view(**paths):
        for name, path in paths.items():
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}'")
        return con

    return view
