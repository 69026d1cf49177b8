"""Column layouts of the tables the library reads and writes."""

from pyspark.sql import types as T

SOURCES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("read_error", T.StringType()),
    ]
)

MEMBER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)

TYPES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("type_ord", T.IntegerType()),
        T.StructField("class_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("method_count", T.IntegerType()),
        T.StructField("property_count", T.IntegerType()),
        T.StructField("line_count", T.IntegerType()),
        T.StructField("initializer_count", T.IntegerType()),
        T.StructField("subscript_count", T.IntegerType()),
        T.StructField("accessor_count", T.IntegerType()),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)

ISSUES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("type_ord", T.IntegerType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)

TOGGLE = T.StructType(
    [
        T.StructField("enabled", T.BooleanType()),
        T.StructField("threshold", T.IntegerType()),
    ]
)

RULE_CONFIG = T.StructType(
    [
        T.StructField("largeClass", TOGGLE),
        T.StructField("highMethodDensity", TOGGLE),
        T.StructField("godObject", TOGGLE),
        T.StructField("dataHeavyClass", TOGGLE),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

FILE_KEY = ["project", "path"]
TYPE_KEY = ["project", "path", "type_ord"]
