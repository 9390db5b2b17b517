"""Schemas of conversation histories. A message's place in its list is the column pos."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("author", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("isFavorite", T.BooleanType(), False),
    ]
)
HISTORY = T.StructType([T.StructField("version", T.IntegerType(), False), T.StructField("messages", T.ArrayType(MESSAGE, False), False)])
VERSION = 1
MESSAGE_COLUMNS = ["conv_id", "pos", "id", "author", "text", "is_favorite"]
RESPONSE = "struct<choices: array<struct<message: struct<role: string, content: string>>>>"
#: What is said of imports and exports (fixed values).
IMPORTED, IMPORTED_END, IMPORT_FAILED = "Imported history: ", " messages.", "Import failed. Invalid file."
EXPORTED, EXPORT_FAILED = "History exported to ", "Export failed. Please try again."
