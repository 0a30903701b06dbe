"""Advisory documents in the OSV JSON format as the ``advisories`` table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "id string, summary string, details string, published string, aliases array<string>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,"
    "last_affected:string>>>>,versions:array<string>>>"
)


def read_advisories(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per advisory and affected package; one document per file or per line."""
    texts = spark.read.text(path, wholetext=whole_files)
    return parse_advisories(texts.select(F.col("value").alias("raw_json")))


def parse_advisories(documents: DataFrame) -> DataFrame:
    """``documents(raw_json)`` to the table; a document without packages has no row."""
    return (
        documents.withColumn("_doc", F.from_json("raw_json", DOCUMENT))
        .select("raw_json", "_doc", F.explode(F.col("_doc.affected")).alias("_one"))
        .select(
            "_doc.id",
            "_one.package.ecosystem",
            F.col("_one.package.name").alias("package"),
            _spans(F.col("_one.ranges")).alias("affected"),
            F.coalesce("_one.versions", F.array().cast("array<string>")).alias("versions"),
            "_doc.summary",
            "_doc.details",
            "_doc.published",
            F.coalesce("_doc.aliases", F.array().cast("array<string>")).alias("aliases"),
            "raw_json",
        )
    )


def _spans(ranges: Column) -> Column:
    """(introduced, fixed) per introduction, from the event that follows it.

    The end of a range given as the last affected version is turned into the
    smallest version after it.
    """

    def spans_of(one):
        events = one["events"]

        def span(event, i):
            after = F.get(events, i + 1)
            past_last = F.concat(after["last_affected"], F.lit(".0.0.0.1"))
            return F.struct(
                event["introduced"].alias("introduced"),
                F.coalesce(after["fixed"], past_last).alias("fixed"),
            )

        return F.filter(F.transform(events, span), lambda s: s["introduced"].isNotNull())

    by_version = F.filter(ranges, lambda r: r["type"] != "GIT")
    none = F.array().cast("array<struct<introduced:string,fixed:string>>")
    return F.coalesce(F.flatten(F.transform(by_version, spans_of)), none)
