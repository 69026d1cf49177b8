"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeaudit.operators.classify import category

SUFFIXES = ["ViewController", "ViewModel", "Service", "Model", "Widget"]


# Declared here so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream. A glob that matches one name also takes a table stored as one file."""
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parque[t]")


def suffix(number: Column) -> Column:
    chosen = None
    for index, value in enumerate(SUFFIXES):
        chosen = (F if chosen is None else chosen).when(number % 5 == index, value)
    return chosen


def _as_types(df: DataFrame) -> DataFrame:
    return df.select(
        "project",
        "path",
        F.substring_index("path", "/", -1).alias("file_name"),
        F.col("type_ord").cast("int").alias("type_ord"),
        category(F.col("name")).alias("class_type"),
        "name",
        *[
            F.coalesce(F.col(column), F.lit(0)).cast("int").alias(column)
            for column in ("method_count", "property_count", "line_count")
        ],
        (F.col("type_ord") % 3).cast("int").alias("initializer_count"),
        (F.col("type_ord") % 2).cast("int").alias("subscript_count"),
        (F.col("type_ord") % 4).cast("int").alias("accessor_count"),
        F.array().cast("array<struct<name:string,start_line:int,end_line:int>>").alias("members"),
    )


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type per part: methods are its line items, properties its suppliers; a file per brand."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count("*").alias("method_count"),
            F.count_distinct("l_suppkey").alias("property_count"),
            F.sum("l_linenumber").alias("line_count"),
        )
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    joined = parts.join(items, parts.p_partkey == items.l_partkey)
    return _as_types(
        joined.select(
            F.lit("parts").alias("project"),
            F.concat(F.lit("parts/"), F.col("p_brand")).alias("path"),
            F.col("p_partkey").alias("type_ord"),
            F.concat(F.col("p_partkey").cast("string"), suffix(F.col("p_size"))).alias("name"),
            "method_count", "property_count", "line_count",
        )
    )


def customer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type per customer: methods are orders, properties open orders, lines are line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    per_customer = (
        orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("method_count"),
            F.count_if(F.col("o_orderstatus") == "O").alias("property_count"),
            F.sum(F.coalesce("items", F.lit(0))).alias("line_count"),
        )
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return _as_types(
        customers.join(nations, customers.c_nationkey == nations.n_nationkey)
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("n_name").alias("project"),
            F.concat(F.lit("customers/"), F.col("n_name")).alias("path"),
            F.col("c_custkey").alias("type_ord"),
            F.concat(F.col("c_custkey").cast("string"), suffix(F.col("c_custkey"))).alias("name"),
            "method_count", "property_count", "line_count",
        )
    )


def all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_types(spark, sf_dir).unionByName(customer_types(spark, sf_dir))


def type_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``all_types``: brands and nations, and one file per region without types."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return (
        brands.select(F.lit("parts").alias("project"), F.concat(F.lit("parts/"), F.col("p_brand")).alias("path"))
        .unionByName(
            table(spark, sf_dir, "nation").select(
                F.col("n_name").alias("project"), F.concat(F.lit("customers/"), F.col("n_name")).alias("path")
            )
        )
        .unionByName(
            table(spark, sf_dir, "region").select(
                F.col("r_name").alias("project"), F.concat(F.lit("regions/"), F.col("r_name")).alias("path")
            )
        )
        .select(
            "*",
            F.substring_index("path", "/", -1).alias("file_name"),
            F.lit("").alias("text"),
            F.lit(None).cast("string").alias("read_error"),
        )
    )


def project_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config text per nation, of every kind: absent, partial, disabled, with folders, broken."""
    key = F.col("n_nationkey").cast("string")
    text = (
        F.when(
            F.col("n_nationkey") % 5 == 1,
            F.concat(
                F.lit('{"rules":{"largeClass":{"threshold":'), key, F.lit('},"dataHeavyClass":{"threshold":'), key,
                F.lit('},"godObject":{"threshold":1}}}'),
            ),
        )
        .when(
            F.col("n_nationkey") % 5 == 2,
            F.lit('{"rules":{"highMethodDensity":{"enabled":false},"largeClass":{"enabled":null}},"unknown":[1]}'),
        )
        .when(
            F.col("n_nationkey") % 5 == 3,
            F.concat(F.lit('{"ignoreDirectories":["Pods","Gen'), key, F.lit('"],"rules":{"godObject":{"enabled":false}}}')),
        )
        .when(
            F.col("n_nationkey") % 5 == 4,
            F.lit('{"ignoreDirectories":["Lost"],"rules":{"largeClass":{"threshold":"many"}}}'),
        )
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"), text.alias("config_text"))


#: Bytes of stored table for each task of an extraction, so that a task's sorts stay the same size as the table grows.
TASK_BYTES = 4 << 20


def task_count(spark: SparkSession, rows: DataFrame) -> int:
    """At least one task for each core; more where the files of ``rows`` are larger than so many parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    stored = 0
    for name in rows.inputFiles():
        file = path(spark._jvm.java.net.URI(name))
        stored += file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by file, so that the extraction moves no elements and each of its tasks holds a part of bounded size."""
    documents = table(spark, sf_dir, "documents")
    return as_document_sources(documents).repartition(task_count(spark, documents), "project", "path")


def as_document_sources(documents: DataFrame) -> DataFrame:
    """A source file per document: each line of the text becomes a member of one class.

    The kind of member goes by the line's index modulo 6: two properties, a method of four lines,
    an initializer, an attributed computed property of three lines, a subscript, a nested struct of
    three lines. Braces in comments and literals are there to be ignored.
    """

    def member(line: Column, index: Column) -> Column:
        number = index.cast("string")
        kind = index % 6
        return (
            F.when(
                kind == 0,
                F.concat(
                    F.lit("    var p"), number, F.lit(": Int = "), number, F.lit(", q"), number,
                    F.lit(' = "{ open" // '), line,
                ),
            )
            .when(
                kind == 1,
                F.concat(
                    F.lit("    func m"), number, F.lit("() {\n        // { "), line,
                    F.lit('\n        let t = "}", u = 2\n    }'),
                ),
            )
            .when(kind == 2, F.concat(F.lit("    init(a"), number, F.lit(": Int, b: Int = 1) { }")))
            .when(
                kind == 3,
                F.concat(
                    F.lit("    @objc(c) public var c"), number,
                    F.lit(': String {\n        /* { /* } */ { */ "x"\n    }'),
                ),
            )
            .when(kind == 4, F.concat(F.lit("    subscript(i"), number, F.lit(": Int) -> Int { 0 }")))
            .otherwise(F.concat(F.lit("    struct N"), number, F.lit(" {\n        let z = 1\n    }")))
        )

    doc = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(F.split("text", "\n", -1), member), "\n")
    text = F.concat(
        F.lit("// { file "), doc, F.lit("\n@MainActor\nfinal class Doc"), doc, suffix(F.col("doc_id")),
        F.lit(": Base, Other {\n"), body, F.lit("\n}\n// end }\n"),
    )
    path = F.concat(F.col("lang"), F.lit("/"), doc, F.lit(".swift"))
    return documents.select(
        F.col("source").alias("project"),
        path.alias("path"),
        F.concat(doc, F.lit(".swift")).alias("file_name"),
        text.alias("text"),
        F.lit(None).cast("string").alias("read_error"),
    )
