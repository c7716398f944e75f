import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, ids array<string>, fingerprint double, "
        "lang_pred int, host int, row string, `odd.name` int")


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark.conf.get("spark.checkpoint.dir")


def rows(texts, lang="en", first=1):
    """Documents with nulls and extra columns whose names clash with results."""
    return [(first + i, t, lang if i % 3 else None, None, None, ["x"], 1.0, 7, 8, "r", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark, shared):
    return lambda texts, **more: spark.createDataFrame(rows(texts, **more), DOCS)


#: Texts at the edges: null, empty, blank, no letter, one word, repeated rows, odd white space, a very long text.
EDGES = [None, "", " \t\r\n", "1234 ;;; 567", "word", "word", "The cat sat on the mat.\nThe cat sat.",
         "The cat sat on the mat.\nThe cat sat.", "a\u00a0\u2003 b \x1c\x85c  d\u3000", "don't we'll I'M\t\t x",
         "e\u0301tude \u0301 mark ẞ İ Σας ﬁ", "日本語 テキスト emoji 😀😀 <|endoftext|> <unk> ▁a", "naïve\x00byte\x7f",
         "lorem ipsum dolor sit amet, " * 9000, "a" * 30000]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of(["x"]).where("false")
