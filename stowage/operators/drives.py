"""Drives: who sees them, their properties, storage classes and store URIs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import parent_folder_path
from .access import applicable_rules
from .scale import broadcast_if_small


def readable_drives(
    drives: DataFrame, rules: DataFrame, user: str, roles: Iterable[str] = ()
) -> DataFrame:
    """Drives with at least one include rule that lets the user read something."""
    granting = applicable_rules(rules, user, roles, "R").where(~F.col("exclude"))
    return drives.join(granting.select("drive_id"), "drive_id", "left_semi")


def drives_of_user(drives: DataFrame, drive_users: DataFrame, user: str) -> DataFrame:
    mine = drive_users.where(F.col("user_name") == user).select("drive_id")
    return drives.join(mine, "drive_id", "left_semi")


def distinct_drives(drive_users: DataFrame, user: str) -> DataFrame:
    return drive_users.where(F.col("user_name") == user).select("drive_id").distinct()


def drives_for_role(
    drives: DataFrame, drive_users: DataFrame, user: str, role: str
) -> DataFrame:
    """All drives for an administrator, own ones for a drive administrator, else none."""
    if role == "ADMIN":
        return drives
    if role == "DRIVE_ADMIN":
        return drives_of_user(drives, drive_users, user)
    return drives.where(F.lit(False))


def public_drives(drives: DataFrame) -> DataFrame:
    """Drives without their properties, users and rules."""
    return drives.drop("properties", "users", "security_rules")


def list_drives(drives: DataFrame) -> DataFrame:
    return drives.orderBy(F.col("display_name").asc_nulls_last(), "drive_id")


# The property keys of each drive type, in display order.
PROPERTY_KEYS = {
    "S3": ["Region", "AccessKey", "AccessSecret", "BucketName", "HiveHostName", "HivePort"],
    "Blob": ["BlobConnectionString", "BlobContainerName", "HiveHostName", "HivePort"],
    "GCS": ["GoogleBucketName", "ProjectId", "GCSCredentials", "HiveHostName", "HivePort"],
    "SMB": ["HostName", "Domain", "UserName", "Password", "ShareName"],
    "Windows": ["DriveName"],
}


def drive_properties(
    drives: DataFrame, properties: DataFrame, valid_keys: dict[str, list[str]] | None = None
) -> DataFrame:
    """Every valid key of every drive in order; a value that is not stored is null."""
    keys = F.lit(None).cast("array<string>")
    for kind, names in (valid_keys or PROPERTY_KEYS).items():
        keys = F.when(F.col("drive_type") == kind, F.array(*[F.lit(n) for n in names])).otherwise(keys)
    wanted = drives.select(
        "drive_id", F.posexplode(keys).alias("ordinal", "property_key")
    )
    return wanted.join(properties, ["drive_id", "property_key"], "left").select(
        "drive_id", "ordinal", "property_key", "property_value"
    )


# Storage classes per drive type as
# (drive type, class, display text, restore required, default).
STORAGE_CLASSES = [
    ("S3", "STANDARD", "Standard", False, True),
    ("S3", "STANDARD_IA", "Standard-IA", False, False),
    ("S3", "ONEZONE_IA", "OneZone-IA", False, False),
    ("S3", "INTELLIGENT_TIERING", "Intelligent", False, False),
    ("S3", "GLACIER", "Glacier", True, False),
    ("S3", "DEEP_ARCHIVE", "Deep Archive", True, False),
    ("S3", "REDUCED_REDUNDANCY", "Reduced Redundancy", False, False),
    ("Blob", "HOT", "Hot", False, True),
    ("Blob", "COOL", "Cool", False, False),
    ("Blob", "ARCHIVE", "Archive", True, False),
    ("GCS", "ARCHIVE", "Archive", False, False),
    ("GCS", "COLDLINE", "Cold Line", False, False),
    ("GCS", "NEARLINE", "Near Line", False, False),
    ("GCS", "STANDARD", "Standard", False, True),
]


def storage_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STORAGE_CLASSES,
        "drive_type string, storage_class string, display_text string,"
        " restore_required boolean, is_default boolean",
    )


def with_drive_type(items: DataFrame, drives: DataFrame) -> DataFrame:
    kinds = drives.select("drive_id", "drive_type")
    return items.join(broadcast_if_small(kinds), "drive_id", "left")


def with_storage_class(items: DataFrame, drives: DataFrame) -> DataFrame:
    """Items with display text, restore flag and default flag of their class."""
    classes = F.broadcast(storage_classes(items.sparkSession))  # a fixed list
    typed = with_drive_type(items, drives)
    return typed.join(classes, ["drive_type", "storage_class"], "left").select(
        *items.columns, "drive_type", "display_text",
        F.coalesce("restore_required", F.lit(False)).alias("restore_required"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"),
    )


def with_location(items: DataFrame, drives: DataFrame, properties: DataFrame) -> DataFrame:
    """The parent folder of each item as a store URI; null for stores without one."""
    def value(key: str) -> Column:
        return F.max(F.when(F.col("property_key") == key, F.col("property_value")))

    stores = (
        drives.select("drive_id", "drive_type")
        .join(properties, "drive_id", "left")
        .groupBy("drive_id", "drive_type")
        .agg(
            value("BucketName").alias("s3"),
            value("GoogleBucketName").alias("gcs"),
            value("BlobContainerName").alias("container"),
            value("BlobConnectionString").alias("connection"),
        )
    )
    settings = F.str_to_map("connection", F.lit(";"), F.lit("="))
    host = F.coalesce(
        F.call_function("parse_url", settings["BlobEndpoint"], F.lit("HOST")),
        F.concat(
            settings["AccountName"], F.lit(".blob."),
            F.coalesce(settings["EndpointSuffix"], F.lit("core.windows.net")),
        ),
    )
    kind = F.col("drive_type")
    prefix = (
        F.when(kind == "S3", F.concat(F.lit("s3a://"), "s3", F.lit("/")))
        .when(kind == "Blob", F.concat(F.lit("wasbs://"), "container", F.lit("@"), host, F.lit("/")))
        .when(kind == "GCS", F.concat(F.lit("gs://"), "gcs", F.lit("/")))
    )
    prefixes = broadcast_if_small(stores.select("drive_id", prefix.alias("_prefix")))
    joined = items.join(prefixes, "drive_id", "left")
    return joined.select(
        *items.columns,
        F.concat("_prefix", parent_folder_path(F.col("path"))).alias("location"),
    )
