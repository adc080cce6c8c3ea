"""Small tables with the awkward cases every operator has to stand, and readers of results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside; a table may have them too.
CLASHING = ["fp", "sha", "norm", "key", "n", "size", "pos", "line", "uid", "set_id", "h1", "text_hash", "score", "trusted", "salt"]

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))

EDGES: list[tuple[int | None, str | None]] = [
    (9001, None),
    (9002, ""),
    (9003, "   \n\t "),
    (9004, "One short text"),
    (9005, "one SHORT text"),
    (9005, "one SHORT text"),
    (9006, LONG),
    (9007, LONG),
    (None, "A text without an id, which stands here alone."),
    (None, None),
    (9008, "Zażółć gęślą jaźń   emoji 🎉🎉 ẞ İ ﬁ <|endoftext|> the end"),
    (9009, "a\nb\n\n\nc\r\nd"),
    (9010, "x" * 5000),
]


def edges(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in CLASHING}).withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})


def empty(spark: SparkSession) -> DataFrame:
    return edges(spark).where("false")


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df: DataFrame) -> list[tuple]:
    """The rows in an order in which nulls have a place."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "float", x) for x in r))


def texts(df: DataFrame) -> list[tuple[int | None, str | None]]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
