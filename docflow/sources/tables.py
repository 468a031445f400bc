"""Relational rows as documents: a row is a document, its columns are leaves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.values import long_norm, number_norm, string_norm

_LONG = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def row_leaves(
    df: DataFrame, ids: dict[str, str], values: list[str], doc_type: str | None = None
) -> DataFrame:
    """Leaf rows of flat rows: the `ids` columns (renamed), key, value, vtype, num, norm.

    One narrow expand; null cells are leaves as well, of the null class.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for name in values:
        col, kind = F.col(name), kinds[name]
        if isinstance(kind, _LONG):
            vtype, num, norm = "LONG", col.cast("double"), long_norm(col)
        elif isinstance(kind, _REAL):
            vtype, num, norm = "DOUBLE", col.cast("double"), number_norm(col.cast("double"))
        elif isinstance(kind, T.BooleanType):
            vtype, num = "BOOLEAN", col.cast("int").cast("double")
            norm = number_norm(num)
        else:
            vtype, num, norm = "STRING", F.lit(None).cast("double"), string_norm(col.cast("string"))
        cells.append(
            F.struct(
                F.lit(name).alias("key"),
                col.cast("string").alias("value"),
                F.when(col.isNull(), "NULL").otherwise(vtype).alias("vtype"),
                num.alias("num"),
                F.coalesce(norm, F.lit("z")).alias("norm"),
            )
        )
    head = [F.col(source).alias(target) for source, target in ids.items()]
    if doc_type is not None:
        head.append(F.lit(doc_type).alias("cluster"))
    return df.select(*head, F.inline(F.array(*cells)))


def row_documents(df: DataFrame, doc_id, doc_type: str, root: str, fields: list[str]) -> DataFrame:
    """Rows as JSON documents `{root: [{fields}]}` with one entry."""
    body = F.struct(*[F.col(f) for f in fields])
    return df.select(
        doc_id.alias("doc_id"),
        F.lit(doc_type).alias("doc_type"),
        F.to_json(F.struct(F.array(body).alias(root))).alias("content"),
    )
