import pytest

from ticketloom.llm.queries import workers_import

LONG = "Anblewh sttible athawh thonre was is anly hend and. " * 3_000

# doc_id, text: nulls, empty and blank texts, ties, repeated rows, special strings, a long text.
ROWS = [
    (1, "The and attion to thanedble the, anea. Eriner thanea."),
    (2, None),
    (3, ""),
    (4, " \n\t \x0b"),
    (None, "Erinre the ththsted thedble wh st thened"),
    (5, "the the the the the the the the the the the the the the the the the the the the the"),
    (5, "the the the the the the the the the the the the the the the the the the the the the"),
    (6, "a<|endoftext|>b <|startoftext|> <s>hi</s> <unk>"),
    (7, "日本語 テスト 🙂🙂 ΟΔΟΣ İ ŉ ß Ǆ e\u0301 x\x1cy\x00z\u0085b\u00a0c"),
    (8, LONG),
    (9, "a" * 4_000),
    (10, "!!! ??? ... ***"),
    (11, "!!! ??? ... ***"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents of all kinds, with further columns named like what operators make."""
    workers_import(spark)
    rows = [(i, t, "x", 7, True, 0.5) for i, t in ROWS]
    schema = "doc_id LONG, text STRING, verdict STRING, n_tokens INT, kept BOOLEAN, `a.score` DOUBLE"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    """The same table without rows."""
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id LONG, quality INT, toxic INT")
