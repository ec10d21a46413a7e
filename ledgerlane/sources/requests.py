"""Order requests as they arrive: JSON lines, JSON text in a column, or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions.values import first_failure
from ledgerlane.schema import ORDER_REQUEST

ITEMS = ORDER_REQUEST["items"].dataType


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests stored as one JSON object per line."""
    return spark.read.schema(ORDER_REQUEST).json(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New request files of a folder, oldest first, stamped with their arrival."""
    arrived = T.StructField("ArrivedAt", T.TimestampType())
    schema = T.StructType([arrived, *ORDER_REQUEST.fields])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def items_from_text(text: Column | str) -> Column:
    """The items of an order given as JSON text; null when it is not such text."""
    return F.from_json(text, ITEMS)


CORRUPT = "_corrupt"


def read_texts(texts: DataFrame, column: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON texts read by a schema: ``Parsed``, and ``Reason`` where a text is refused, in place of the text's column.

    ``no_text``: null or blank; ``malformed``: no JSON; ``no_object``: JSON of another kind; ``wrong_type``: a value, also
    one inside an array, that doesn't fit the schema; ``missing_x``: the first of the ``required`` fields that is missing or
    null; ``no_x``: a required array without entries.  Fields that the schema lacks are passed over.  Refused texts have no
    ``Parsed``.  Other columns stay.
    """
    text = F.col(column)
    known = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = F.from_json(text, known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    form = F.try_parse_json(text)
    judged = texts.withColumns({"_read": read, "_form": F.schema_of_variant(form)})
    checks = [
        (text.isNull() | (F.trim(text) == ""), "no_text"),
        (F.col("_form").isNull(), "malformed"),
        (~F.startswith(F.col("_form"), F.lit("OBJECT")), "no_object"),
        (F.col(f"_read.{CORRUPT}").isNotNull(), "wrong_type"),
        *((F.col(f"_read.{name}").isNull(), f"missing_{name}") for name in required),
        *((F.size(f"_read.{name}") == 0, f"no_{name}") for name in required
          if isinstance(schema[name].dataType, T.ArrayType)),
    ]
    fields = F.struct(*(F.col(f"_read.{name}").alias(name) for name in schema.names))
    judged = judged.withColumn("Reason", first_failure(checks))
    judged = judged.withColumn("Parsed", F.when(F.col("Reason").isNull(), fields))
    return judged.drop("_read", "_form")


def write_read(judged: DataFrame, accepted: str, refused: str) -> None:
    """Accepted requests as Parquet, refused ones with their text and reason, a folder for each reason.

    The judged rows are read twice; save them first where that is dear.
    """
    judged.filter("Reason IS NULL").select("Parsed.*").write.mode("append").parquet(accepted)
    judged.filter("Reason IS NOT NULL").drop("Parsed").write.mode("append").partitionBy("Reason").parquet(refused)
