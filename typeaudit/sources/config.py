"""Project configuration: JSON text to a merged settings struct, one row per project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit import schema
from typeaudit.operators.rules import DEFAULT_THRESHOLDS
from typeaudit.sources import listing

# Folders that are never scanned.
DEFAULT_IGNORED = [".build", ".git", ".swiftpm", "DerivedData", "Pods", "Build", "Carthage"]

DEFAULT_FILE = ".typeaudit.json"

_CORRUPT = "_corrupt_record"
_USER = T.StructType(
    [
        T.StructField("ignoreDirectories", T.ArrayType(T.StringType())),
        T.StructField("rules", schema.RULE_CONFIG),
        T.StructField(_CORRUPT, T.StringType()),
    ]
)


def parse(text: Column) -> Column:
    """The user's settings, or null where the whole text cannot be decoded.

    Unknown keys are ignored, every known key is optional, one wrong type voids the file.
    """
    decoded = F.from_json(text, _USER, {"columnNameOfCorruptRecord": _CORRUPT})
    # A string field accepts any JSON scalar, so the element type is looked at separately.
    names = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.ignoreDirectories", "variant"))
    names_fit = F.coalesce(names, F.lit("VOID")).isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(decoded[_CORRUPT].isNull() & names_fit, decoded)


def _default_names() -> Column:
    return F.array(*[F.lit(name) for name in DEFAULT_IGNORED])


def _merged_toggle(user: Column, key: str) -> Column:
    default = F.lit(DEFAULT_THRESHOLDS[key]).cast("int")
    # The God Object limits cannot be configured.
    threshold = default if DEFAULT_THRESHOLDS[key] is None else F.coalesce(user["rules"][key]["threshold"], default)
    return F.struct(
        F.coalesce(user["rules"][key]["enabled"], F.lit(True)).alias("enabled"), threshold.alias("threshold")
    )


def merge(configs: DataFrame, text: str = "config_text") -> DataFrame:
    """``(project, config_text)`` to ``(project, ignore_directories, rules)``; null text is default."""
    user = F.col("user")
    extra = F.coalesce(user["ignoreDirectories"], F.array().cast("array<string>"))
    return configs.withColumn("user", parse(F.col(text))).select(
        "project",
        F.array_union(_default_names(), extra).alias("ignore_directories"),
        F.struct(*[_merged_toggle(user, key).alias(key) for key in DEFAULT_THRESHOLDS]).alias("rules"),
    )


def default_rules() -> Column:
    """The settings of a project without a config file."""
    return F.struct(
        *[
            F.struct(F.lit(True).alias("enabled"), F.lit(value).cast("int").alias("threshold")).alias(key)
            for key, value in DEFAULT_THRESHOLDS.items()
        ]
    )


def read_configs(projects: DataFrame, file_name: str = DEFAULT_FILE, opened: Callable = listing.opened) -> DataFrame:
    """Merged config of each row of ``projects(project, folder)``; a missing file means defaults.

    Config files usually have dot names, which Spark's own file listing hides, so each task opens
    the small files of its projects itself, through ``opened``: a folder to an Arrow file system and a path.
    Where the texts are in a table ``(project, config_text)`` already, give that to ``merge``.
    """

    def read(batches):
        from pyarrow import fs

        def text_of(folder: str) -> str | None:
            where, path = opened(folder)
            target = f"{path.rstrip('/')}/{file_name}"
            if where.get_file_info(target).type != fs.FileType.File:
                return None
            with where.open_input_stream(target) as stream:
                content = stream.read()
            try:
                return content.decode("utf-8")
            except UnicodeDecodeError:
                return ""

        for batch in batches:
            yield batch.assign(config_text=[text_of(folder) for folder in batch["folder"]])[["project", "config_text"]]

    texts = projects.select("project", "folder").mapInPandas(read, "project string, config_text string")
    return merge(texts)


def with_config(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Attach ``config_rules`` and ``config_ignored`` to each row by project.

    The config side is small per project but grows with the number of projects, so no broadcast
    is forced: the planner broadcasts it when its size allows and otherwise splits hot projects.
    """
    side = configs.select(
        "project", F.col("rules").alias("config_rules"), F.col("ignore_directories").alias("config_ignored")
    )
    joined = df.join(side, "project", "left")
    return joined.withColumns(
        {
            "config_rules": F.coalesce("config_rules", default_rules()),
            "config_ignored": F.coalesce("config_ignored", _default_names()),
        }
    )
