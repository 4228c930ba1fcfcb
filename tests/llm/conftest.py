import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of a small table, by id."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
            .orderBy("doc_id").collect()]


ODD_TEXTS = [None, "", " ", "\n\t", "one", "ü ▁ é漢字 😀\x00", "a b c d", "a b c d e", "same line\nsame line\nsame line",
             "x" * 3000, "word " * 2000, "Call +1 212 555 1234 or a@b.co, 4111 1111 1111 1111."]


#: Names that the operators use, or used, inside.
CLASHING = ("_text", "__text", "__ids", "stratum", "row", "key", "kid", "_key", "_copy", "_copies", "__kid", "__key", "__rid", "__more",
            "__base", "__SPANS", "first", "h", "at", "hash")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "null id", "en", "s", None), (None, None, None, None, None)]
    clash = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, 7, "k", *[f"own {c}" for c in CLASHING]) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 f"shard int, copies string, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
