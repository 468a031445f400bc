"""Files as documents: folder scan, routing by extension, JSON and XML content, rejects, export."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from docflow.functions.names import base_name
from docflow.session import cut_lineage

# File kinds that are listed; text files are listed but not read as documents.
LISTED = "*.{json,xml,txt}"
_CORRUPT = "_malformed"
#: In place of a schema: XML files of any shape.
ANY_XML = "variant"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every listed file below `path`, whole, with the metadata Spark offers.

    Creation and access time are not offered by Spark and stay null.
    """
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", LISTED)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            "value",
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
            F.lit(None).cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("accessed_at"),
        )
    )


def route(path: Column) -> Column:
    """Kind of a file by its extension."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".json"), "json").when(low.endswith(".xml"), "xml").otherwise("unsupported")
    )


def xml_content(value: Column, schema: str, last_wins: bool = False) -> Column:
    """XML text as JSON text with the fields of `schema` (root tag and attributes left out).

    Repeated tags are kept as arrays when the schema says so; `last_wins=True` keeps only the last of
    them.  Text that is no well-formed XML, or does not fit the schema, gives null.
    """
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = F.from_xml(value, f"{schema}, `{_CORRUPT}` STRING", options)
    fields = StructType.fromDDL(schema).fields
    shown = [(_last(parsed[f.name], f.dataType) if last_wins else parsed[f.name]).alias(f.name) for f in fields]
    return F.when(parsed[_CORRUPT].isNull(), F.to_json(F.struct(*shown)))


def xml_variant(value: Column) -> Column:
    """XML text of any shape as JSON text: the fields are the tags, whatever they are (root tag and attributes left out).

    Repeated tags become arrays.  Numbers and true / false are read as such, so a number loses leading zeros; text beside
    child elements stands under `_VALUE`.  Text that is no well-formed XML gives null: it is looked at first, as parsing
    it into a variant would stop the job.
    """
    corrupt = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": _CORRUPT}
    formed = F.from_xml(value, f"`{_CORRUPT}` STRING", corrupt)[_CORRUPT].isNull()
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "excludeAttribute": "true"}
    # Inside a higher-order function the parser is called as it is; as part of generated code it does not compile.
    read = F.transform(F.array(F.when(formed, value)), lambda text: F.from_xml(text, "variant", options))
    return F.to_json(read[0])


def _last(value: Column, kind: DataType) -> Column:
    """The value with every array in it replaced by its last element, at all levels."""
    if isinstance(kind, ArrayType):
        return _last(F.try_element_at(value, F.lit(-1)), kind.elementType)
    if isinstance(kind, StructType):
        inner = F.struct(*[_last(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def parse_raw(
    raw: DataFrame, xml_schema: str | None = None, last_wins: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from rows of path and value.

    documents: doc_id, path, title, kind, content (JSON text) and the metadata columns.
    rejects: path and reason; a malformed file never stops the others.
    `xml_schema` is the DDL of the XML files' fields, or ANY_XML to read files of any shape (see xml_variant); `last_wins`
    needs a DDL.  Without it XML files are rejected.
    """
    if last_wins and xml_schema in (None, ANY_XML):
        raise ValueError("last_wins needs the fields of the XML files")
    kind = route(F.col("path"))
    json_ok = F.try_parse_json("value")
    content = F.when(F.col("kind") == "json", F.when(json_ok.isNotNull(), F.col("value")))
    if xml_schema is not None:
        value = F.col("value")
        xml = xml_variant(value) if xml_schema == ANY_XML else xml_content(value, xml_schema, last_wins)
        content = content.when(F.col("kind") == "xml", xml)
    routed = raw.withColumn("kind", kind).withColumn("content", content)
    meta = [c for c in ("file_size", "modified_at", "created_at", "accessed_at") if c in raw.columns]
    # Parsed once: both results would parse every file again, to choose its rows and to fill them.
    if not raw.isStreaming:
        routed = cut_lineage(routed.select("path", "kind", "content", *meta))
    documents = routed.where(F.col("content").isNotNull()).select(
        F.xxhash64("path").alias("doc_id"),
        "path",
        F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "").alias("title"),
        "kind",
        "content",
        *meta,
    )
    rejects = routed.where(F.col("content").isNull()).select(
        "path",
        F.when(F.col("kind") == "unsupported", "unsupported extension")
        .when((F.col("kind") == "xml") & F.lit(xml_schema is None), "no xml schema given")
        .otherwise("malformed content")
        .alias("reason"),
    )
    return documents, rejects


def infer_xml_schema(spark: SparkSession, path: str, row_tag: str) -> str:
    """Schema of the XML files below `path` as DDL; attributes are dropped."""
    found = (
        spark.read.option("rowTag", row_tag)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xml")
        .option("excludeAttribute", True)
        .option("inferSchema", False)
        .format("xml")
        .load(path)
        .schema
    )

    def ddl(kind):
        if isinstance(kind, StructType):
            return "STRUCT<" + ", ".join(f"`{f.name}`: {ddl(f.dataType)}" for f in kind.fields) + ">"
        if isinstance(kind, ArrayType):
            return f"ARRAY<{ddl(kind.elementType)}>"
        return kind.simpleString()

    return ", ".join(f"`{f.name}` {ddl(f.dataType)}" for f in found.fields)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def export_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
