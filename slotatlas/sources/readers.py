"""Sources: JSON envelopes, dynamic maps, encoded payloads, change logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas import schemas
from slotatlas.functions.timefn import col, let
from slotatlas.operators.joins import alias_key


def read_envelopes(spark: SparkSession, path: str, schema: str, array_col: str, part_col: str = "part",
                   part_pattern: str = r"_([^_/.]+)\.json$", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Envelope files to record rows, and the rows that are not readable.

    The partition comes from the file path; files with ``.enc.`` in the name
    are skipped. A malformed document goes to the second DataFrame, with its
    file, and the run goes on.
    """
    raw = spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").option("multiLine", multi_line) \
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).json(path) \
        .withColumn("_file", F.col("_metadata.file_path"))
    raw = raw.filter(~F.contains("_file", F.lit(".enc.")))
    envelope = [c for c in raw.columns if c not in (array_col, "_corrupt_record", "_file")]
    rows = raw.filter(F.col(array_col).isNotNull()).select(
        F.regexp_extract("_file", part_pattern, 1).alias(part_col),
        *[F.col(c).alias(f"envelope_{c.strip('_')}") for c in envelope], F.inline(array_col))
    bad = raw.filter(F.col(array_col).isNull()).select("_file", F.col("_corrupt_record").alias("record"))
    return rows, bad


def read_catalog(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_envelopes(spark, path, schemas.PLACE_ENVELOPE, "studios", **options)[0]


def read_schedule(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_envelopes(spark, path, schemas.SLOT_ENVELOPE, "classes", **options)[0]


def read_dimension(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """Nested dimension records with their data key (the id, or its alias)."""
    rows = spark.read.schema(schemas.DIMENSION_ENVELOPE).option("multiLine", multi_line).json(path).select(F.inline("cantons"))
    return rows.withColumn("data_key", alias_key("id", aliases or {"basel-stadt": "basel"}))


def dynamic_map(docs: DataFrame, text: str, fields: list[str], wrapper: str = "studios") -> DataFrame:
    """Objects whose keys are ids, in three layouts: flat, wrapped, nested by partition.

    An entry is a record when it holds one of the fields; other objects are one
    level of nesting; scalars and keys with ``_`` in front are metadata.
    """
    def entries(doc: Column) -> Column:
        return F.map_entries(F.map_filter(F.from_json(doc, "map<string,string>"),
                                          lambda k, v: ~F.startswith(k, F.lit("_")) & F.startswith(F.ltrim(v), F.lit("{"))))

    def is_record(v: Column) -> Column:
        return F.exists(F.map_keys(F.from_json(v, "map<string,string>")), lambda k: k.isin(fields))

    # Top level: records stay, containers open once more.
    top = docs.select(F.explode(entries(col(text))).alias("e")).select("e.key", "e.value", is_record(F.col("e.value")).alias("rec"))
    opened = F.when(F.col("rec"), F.array(F.struct(F.col("key"), F.col("value")))).otherwise(entries(F.col("value")))
    part = F.when(~F.col("rec") & (F.col("key") != wrapper), F.col("key"))
    rows = top.select(part.alias("part"), F.explode(opened).alias("r")).filter(is_record(F.col("r.value")))
    return rows.select("part", F.col("r.key").alias("id"),
                       *[F.get_json_object("r.value", f"$.{f}").alias(f) for f in fields])


def read_dynamic_maps(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    return dynamic_map(spark.read.text(path, wholetext=True), "value", fields)


def encode_payload(text) -> Column:
    """Reversed base64 without line breaks."""
    return F.reverse(F.regexp_replace(F.base64(F.encode(col(text), "UTF-8")), r"[\r\n]", ""))


def decode_payload(encoded) -> Column:
    """Inverse of :func:`encode_payload`; null when it is not decodable."""
    raw = F.reverse(col(encoded))
    ok = raw.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(ok, F.unbase64(raw).cast("string"))


def decode_envelopes(encoded: DataFrame, plain: DataFrame, key: str) -> DataFrame:
    """Decoded document per key, else the plain one. ``encoded``: (key, e); ``plain``: (key, text)."""
    both = encoded.join(plain, key, "full")
    return both.select(key, let(decode_payload("e"), lambda d: F.struct(
        F.coalesce(d, F.col("text")).alias("text"),
        F.when(d.isNotNull(), F.lit("encoded")).otherwise(F.lit("plain")).alias("origin"))).alias("r")).select(key, "r.*")


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """Change log, JSON lines or arrays; a missing log is empty. What is not readable: `changelog_parts`."""
    return changelog_parts(spark, path)[0]


def changelog_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Change rows, and the records that are no changes with their file (``file``, ``record``)."""
    try:
        raw = spark.read.schema(f"{schemas.CHANGE}, _corrupt_record STRING").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.CHANGE), spark.createDataFrame([], "file string, record string")
    # Spark parses the columns a query asks for; whether a record is broken must not depend on them, so all are read.
    whole = F.length(F.to_json(F.struct(*[c for c in raw.columns if c != "_corrupt_record"]))) > 0
    rows = raw.filter(F.col("_corrupt_record").isNull() & whole).drop("_corrupt_record")
    broken = raw.filter(F.col("_corrupt_record").isNotNull() & whole)
    return rows, broken.select(F.col("_metadata.file_path").alias("file"), F.col("_corrupt_record").alias("record"))
