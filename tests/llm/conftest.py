import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Nulls, empty and blank texts, ties, repeated rows, odd white space, a long text, four-byte characters.
ODD = [
    None,
    "",
    " ",
    "\n",
    "plain words here",
    "plain words here",
    " leading and trailing ",
    "two  spaces\n\nand lines\tand tabs \n x",
    "it's we'll I'm they've DON'T 'quoted'",
    "no break wide 　ideographic",
    "naïve café \U0001f600\U0001f600 12345 67 ١٢",
    "nul\0inside and <|endoftext|> there",
    "a" * 300,
    "word " * 3000,
    "x",
]


def rows(texts):
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([*rows(ODD), (4, "plain words here", None, None, None), (None, "no id", "en", "src1", 5)], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)
