import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, score string, language int, "
          "n_tokens string, bucket int, md5 string, class_id string, part int, spans int, "
          "__id long, __text_md5 string, prior_host string, __ev_host string, __toxicity double, __language string, __Rejected int, row string, host int")
CLASHING = ("__id", "__text_md5", "prior_host", "__ev_host", "__toxicity", "__language", "__Rejected", "row", "host")
CLASH_VALUES = (7, "t5", "ph", "eh", 0.25, "xx", 3, "r", 4)
SENTENCE = "The quick brown fox and the lazy dog are here, with a word of the day for it. "


def _row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, "z", 2, "m", "c", 3, 4, *CLASH_VALUES)


EDGE_ROWS = [
    _row(1, None), _row(2, ""), _row(3, SENTENCE * 4000), _row(4, SENTENCE), _row(4, SENTENCE), _row(5, SENTENCE), _row(None, "null id of a text"),
    _row(6, "###"), _row(7, " \n\t "), _row(8, "one", None, None), _row(9, "écoute 中文 🙂 \x00 <|endoftext|> é́", "fr", ""),
    _row(10, "Write to a.b@c.example.com or +1 (212) 555-0142 from 10.0.0.1.\n" + SENTENCE), _row(11, "x" * 50_000),
    _row(None, None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank and very long texts, repeated rows, null ids, clashing column names."""
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashes_kept(df):
    """Whether the columns with clashing names came back with their values."""
    return all(tuple(r) == CLASH_VALUES for r in df.select(*CLASHING).collect())


def by_id(rows):
    """Rows as sorted tuples (null ids first)."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
