"""Small fixtures: a table of edge cases, an empty one, and DuckDB over either."""

import duckdb
import pytest
from pyspark.sql import functions as F

def prose(*numbers):
    """Lines of prose that share no words."""
    words = "the quick brown fox jumps over a lazy dog near river bank and nobody saw it leave again today"
    return "".join(" ".join(f"{w}{i}" for w in words.split()).capitalize() + ".\n" for i in numbers)


def edge_rows():
    long_text = " ".join(f"word{i % 977} and{i % 13}." for i in range(6000)) + "\nEnd of it."
    base = " ".join(f"token{i}" for i in range(120)) + "."
    near = base.replace("token60", "other60")
    texts = [
        None, "", "   \n\t ", "one", "two words", "THREE short words", base, base, near, base.upper(), long_text,
        prose(1, 2, 3, 4), prose(1, 2, 3, 4), prose(5) + "Home | About | Contact | Login\n" + prose(6, 7, 8), "word " * 80, "é 漢字   x\x0by\x0cz\r\n",
        "Released under the MIT License. MIT license, gnu general public license; CC BY!", "a.b@mail1.example.com or +1 (212) 555-1234",
        "### $$$ %%% &&& " * 20, near + " tail", "x" * 3000, "ab" * 700 + " " + "cd" * 10,
    ]
    rows = [(i, t, "en", ["src1", "src0", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(6, base, "en", "src1", len(base)), (None, base, "en", None, len(base)), (None, "alone here", None, "src0", 10)]
    return rows


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Folder with ``documents`` and ``pages`` of edge cases and clashing extra columns."""
    d = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(edge_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = "id key c x y n w sig low words lines grams n_words kept base host path label labels size target taken copies digest file row block train h".split()
    docs.withColumns({c: F.lit(7) for c in clash}).coalesce(2).write.parquet(f"{d}/documents.parquet")
    article = "<html><body><nav><a>Menu</a></nav><article><h1>T &amp; t</h1><p>One<p>two <b>bold</b> text</article><footer>f</footer></body></html>"
    pages = [
        (0, "http://A.example.ORG/en/1?x=1", article), (1, None, None), (2, "no host", ""), (3, "https://b.com/fr/x", "plain &lt;text&gt;"),
        (0, "http://A.example.ORG/en/1?x=1", article), (None, "https://casino-x.example.net/", "<p>unclosed <b>tag"), (5, "://", "<div>" * 3000 + "deep"),
    ] + [(10 + i, f"http://s.net/{i}", f"<body><div>Same box</div><p>Own text {i} of the page</p></body>") for i in range(12)]
    pages = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    pages.withColumns({c: F.lit("z") for c in ("id", "key", "host", "path", "text", "found", "h", "rule", "verdict", "depth", "features")}).coalesce(2).write.parquet(f"{d}/pages.parquet")
    vectors = [(i, [((i * k) % 11 - 5) / 4 for k in range(1, 6)], i % 3) for i in range(0, 260)]
    vectors += [(300, None, 1), (301, [1.0] * 5, None), (302, [1.0, None, 0.0, 0.0, 0.0], 1), (303, [float("nan")] * 5, 1), (400, [0.0] * 5, 2)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, edges, tmp_path_factory):
    """The same tables without rows."""
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{edges}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="session")
def duck():
    """Run SQL on the tables of a folder."""

    def run(folder, sql):
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        rows = con.execute(sql)
        names = [x[0] for x in rows.description]
        return names, rows.fetchall()

    return run


def same(df, names, rows):
    """Equal rows, whatever their order."""
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, rows))
