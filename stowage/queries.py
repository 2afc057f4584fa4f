"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .datasets import Tables
from .functions import levels, paths, scalars
from .operators import access, audit, content, drives, grid, lookup, query, usage
from .plans import archive, expiry, removal, sequence, transfer
from .session import materialize, shared_folder, ship_package
from .sources import catalog, csv_schemas, files, lines, schemas, snapshots, stores
from .streaming import jobs

USER = "ann"
ROLES = ["catalogreaders"]
DRIVE = 7
AUDIT_COLUMNS = ["action_audit_id", "username", "action", "path", "message"]
NOW = "1998-06-01 12:30:00"
TEMP_PREFIX = "O1"


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _day(column: str, name: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(name)


def _listing(test: Callable[[], Column]) -> Callable[[Tables], DataFrame]:
    return lambda t: t.listing().where(test())


def _grid(*filters: grid.GridFilter) -> Callable[[Tables], DataFrame]:
    return lambda t: grid.grid_filter(t.action_audit(), list(filters), t.drive()).select(AUDIT_COLUMNS)


def _sized_listing(t: Tables) -> DataFrame:
    items = t.drive_item().select("drive_id", "path", "file_size")
    folders = query.ancestor_closure(t.drive_item()).withColumn("file_size", F.lit(0).cast("bigint"))
    return items.unionByName(folders)


def _full_listing(t: Tables) -> DataFrame:
    return t.listing().withColumn("directory", paths.is_directory(F.col("path")))


# --- sources and sinks ------------------------------------------------------


def _stored_items(t: Tables, purpose: str) -> str:
    """Documents as text files below one folder per source, for the file jobs."""
    folder = shared_folder(t.spark, purpose)
    t.raw("documents").select("text", "source").write.partitionBy("source").option(
        "maxRecordsPerFile", 1000
    ).text(folder)
    return folder


def _data_files(t: Tables, folder: str) -> DataFrame:
    """The data files Spark wrote below a folder, without its checksum and marker files."""
    name = paths.file_name(F.col("path"))
    return stores.path_table(t.spark, folder).where(name.startswith("part-"))


def _ordered_files(t: Tables, purpose: str) -> DataFrame:
    """Documents by id in text files of a hundred ids each, one file per folder."""
    folder = shared_folder(t.spark, purpose)
    docs = t.raw("documents").select(
        "doc_id", "text", F.expr("doc_id div 100").alias("shelf")
    )
    docs.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select(
        "text", "shelf"
    ).write.partitionBy("shelf").text(folder)
    return _data_files(t, folder)


def _shelf() -> Column:
    return F.regexp_extract("path", "shelf=([0-9]+)/", 1).cast("bigint").alias("shelf")


def _source_of(path: str = "path") -> Column:
    return F.regexp_extract(path, "source=([^/]+)/", 1).alias("source")


def _per_source(df: DataFrame, size: Column, path: str = "path") -> DataFrame:
    return df.groupBy(_source_of(path)).agg(F.sum(size).cast("bigint").alias("bytes"))


def scan_catalog(t: Tables) -> DataFrame:
    """Files and bytes below a store; checksum files that lie next to the data are left out."""
    listed = catalog.scan_catalog(t.spark, _stored_items(t, "scan"), 1)
    data = listed.where(query.name_matches("part-.*[.]txt"))
    return data.groupBy("drive_id", _source_of()).agg(F.sum("file_size").alias("bytes"))


def normalize_items(t: Tables) -> DataFrame:
    listing = t.listed_item().select(
        F.concat(F.lit("file:///store/"), "path").alias("path"),
        F.col("file_size").alias("length"),
        F.col("modified_date").alias("modificationTime"),
        "storage_class",
    )
    items = catalog.normalize_items(listing, 1, "/store")
    return items.select(
        "drive_id", "path", "file_size", _day("modified_date", "day"), "directory", "storage_class"
    )


def _new_files(t: Tables, folder: str, out: str) -> DataFrame:
    stream = jobs.stream_catalog(t.spark, folder, 1, f"{out}/listed")
    return stream.where(query.name_matches("part-.*[.]txt"))


def stream_catalog(t: Tables) -> DataFrame:
    folder = _stored_items(t, "stream-scan")
    out = shared_folder(t.spark, "stream-catalog")
    _new_files(t, folder, out).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True
    ).format("parquet").start(f"{out}/items").awaitTermination()
    return _per_source(t.spark.read.parquet(f"{out}/items"), F.col("file_size"))


def stream_usage_history(t: Tables) -> DataFrame:
    folder = _stored_items(t, "stream-usage")
    out = shared_folder(t.spark, "stream-history")
    stream = _new_files(t, folder, out)
    jobs.stream_usage_history(stream, f"{out}/history", f"{out}/checkpoint").awaitTermination()
    history = jobs.read_stream_history(t.spark, f"{out}/history")
    return history.groupBy("drive_id", "path").agg(F.sum("bytes").alias("bytes"))


def write_usage_snapshot(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "snapshot")
    snapshots.append_snapshot(t.drive_item(), t.drive(), "2024-01-01 00:00:00", folder)
    marker = usage.is_marker()
    return (
        snapshots.read_usage(t.spark, folder)
        .groupBy("drive_id")
        .agg(
            F.count(F.when(~marker, 1)).alias("files"),
            F.sum("bytes").alias("bytes"),
            F.count(F.when(marker, 1)).alias("markers"),
        )
        .where("files > 0")
    )


def stored_usage(t: Tables) -> DataFrame:
    """Two runs appended to a stored table, the second still open on one drive, then rolled up."""
    folder = shared_folder(t.spark, "usage")
    items, drives = t.drive_item(), t.drive()
    first, closed = items.where("file_size < 20480"), drives.where("drive_id <> 24")
    snapshots.append_snapshot(first, drives, "2024-01-01 00:00:00", folder)
    snapshots.append_snapshot(items, closed, "2024-01-01 01:00:00", folder)
    return usage.usage_rollup(snapshots.read_usage(t.spark, folder))


def folded_rollup(t: Tables) -> DataFrame:
    """Stored folder totals after both runs of every drive were folded in, one after the other."""
    folder = shared_folder(t.spark, "rollup")
    table = t.memory_usage()
    closed = table.where(usage.is_marker()).select("drive_id", "created")
    files = table.where(~usage.is_marker()).join(closed, ["drive_id", "created"], "left_semi")
    started = ["2024-01-01 00:00:00", "2024-01-01 01:00:00"]
    first, second = [files.where(F.col("created") == F.lit(s).cast("timestamp")) for s in started]
    later = closed.where(F.col("created") == F.lit(started[1]).cast("timestamp")).select("drive_id")
    snapshots.fold_rollup(usage.rollup_changes(first.limit(0), first), started[0], folder)
    again = first.join(later, "drive_id", "left_semi")
    snapshots.fold_rollup(usage.rollup_changes(again, second), started[1], folder)
    return snapshots.read_rollup(t.spark, folder)


def write_usage_history(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "history")
    snapshot = t.drive_item().select("drive_id", "path", F.col("file_size").alias("bytes"))
    snapshots.append_history(snapshot, t.drive(), "2024-01-01 00:00:00", folder)
    return snapshots.read_history(t.spark, folder).select("drive_id", "bytes", "path")


def audit_sink(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "audit")
    events = t.action_audit().withColumn("updated", F.col("created"))
    snapshots.append_audit(events, folder)
    done = events.where(F.col("status") == "P").withColumns(
        {"status": F.lit("S"), "updated": F.col("created") + F.expr("INTERVAL 1 MINUTE")}
    )
    snapshots.append_audit(done, folder)
    return snapshots.read_audit(t.spark, folder).select(
        "action_audit_id", "status", "bytes_transferred"
    )


def external_table(t: Tables) -> DataFrame:
    name = f"orders_{shared_folder(t.spark, 'x').rsplit('-', 1)[1]}"
    folder = shared_folder(t.spark, "external")
    t.raw("orders").write.parquet(folder)
    table = schemas.register_external(t.spark, "default", name, folder, "parquet")
    return table.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def external_table_csv(t: Tables) -> DataFrame:
    name = f"customer_{shared_folder(t.spark, 'x').rsplit('-', 1)[1]}"
    folder = shared_folder(t.spark, "external-csv")
    t.raw("customer").write.option("header", "true").csv(folder)
    return schemas.register_external(t.spark, "default", name, folder, "csv")


def schema_to_hive(t: Tables) -> DataFrame:
    """Hive types of a nested table made of orders and their lines."""
    folder = shared_folder(t.spark, "nested")
    line = F.struct("l_linenumber", "l_quantity", F.array("l_discount", "l_tax").alias("rates"))
    t.raw("lineitem").select(
        "l_orderkey", line.alias("line"), F.create_map("l_returnflag", "l_shipdate").alias("shipped")
    ).write.parquet(folder)
    described = schemas.describe_files(t.spark, folder, "parquet")
    return described.select("ordinal", "name", "type").distinct()


CSV_TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")


def infer_csv_schema(t: Tables) -> DataFrame:
    """Columns of the given tables written as CSV files, a folder a table, described in one job."""
    folder = shared_folder(t.spark, "csv")
    for name in CSV_TABLES:
        t.raw(name).write.options(header="true", escape='"').csv(f"{folder}/{name}")
    written = stores.path_table(t.spark, folder).where(F.col("path").endswith(".csv"))
    table = F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1)
    described = csv_schemas.described_columns(csv_schemas.csv_columns(written), table)
    return described.withColumnRenamed("file", "table_name")


def infer_parquet_schema(t: Tables) -> DataFrame:
    """Columns of the given tables; a table in several files has them once."""
    described = schemas.describe_files(t.spark, t.sf_dir, "parquet")
    table = F.regexp_extract("file", "/([a-z]+)[.]parquet", 1).alias("table_name")
    return described.select(table, "ordinal", "name", "type", "error").distinct()


def byte_range(t: Tables) -> DataFrame:
    """All bytes of all files, read as blocks."""
    stored = _data_files(t, _stored_items(t, "ranges"))
    return _per_source(files.byte_range(stored, 0, 1 << 40, 100_000), F.length("data"))


def bulk_copy(t: Tables) -> DataFrame:
    stored = _data_files(t, _stored_items(t, "copy"))
    out = shared_folder(t.spark, "copied")
    inside = F.regexp_extract("path", "/copy-[0-9a-f]+/(.*)", 1)
    plan = stored.select(
        F.col("path").alias("source"),
        F.concat(F.lit(f"{out}/files/"), inside).alias("target"),
        F.lit(False).alias("remove_source"),
    )
    audit_rows = files.bulk_copy(plan, f"{out}/audit")
    return audit_rows.groupBy("status", _source_of("target")).agg(
        F.sum("bytes_transferred").alias("bytes")
    )


def extract_archives(t: Tables) -> DataFrame:
    """Documents written as gzip files by Spark, read back from the archives."""
    folder = shared_folder(t.spark, "archives")
    t.raw("documents").select("text", "source").write.partitionBy("source").option(
        "compression", "gzip"
    ).text(folder)
    return _per_source(files.extract_archives(_data_files(t, folder)), F.length("data"), "archive")


def file_lines(t: Tables) -> DataFrame:
    found = lines.file_lines(_data_files(t, _stored_items(t, "lines")))
    return found.groupBy(_source_of()).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("line")).cast("bigint").alias("bytes"),
    )


def file_top_lines(t: Tables) -> DataFrame:
    found = lines.file_top_lines(_ordered_files(t, "top-lines"), 5)
    return found.select(_shelf(), "line_no", "line")


def file_preview(t: Tables) -> DataFrame:
    return lines.file_preview(_ordered_files(t, "preview"), 3, 2).select(_shelf(), "line")


# --- profiles ---------------------------------------------------------------


def value_profile(t: Tables) -> DataFrame:
    path = F.col("path")
    expires = F.when(F.col("storage_class") != "GLACIER", F.col("modified_date"))
    return t.drive_item().select(
        "drive_id",
        "path",
        scalars.chunk_size(F.col("file_size") * 5_000_000).alias("chunk_size"),
        scalars.safe_value(path, 8).alias("safe_value"),
        scalars.timestamp_name(F.col("modified_date")).alias("timestamp_name"),
        scalars.restore_expiry(F.lit(False), expires).alias("restore_expiry"),
        scalars.is_empty(F.col("file_size")).alias("is_empty"),
        paths.is_inside(path, F.lit("/A/F/")).alias("is_inside"),
        paths.matches_path(path, F.lit("/A/F/p1/")).alias("matches_path"),
        paths.relative_path(F.lit("A/F"), path).alias("relative_path"),
        paths.rebase_path(path, F.lit("A/F/"), F.lit("Z/")).alias("rebase_path"),
        F.array_join(scalars.users_list(F.translate(path, "/", ";")), ",").alias("users_list"),
        levels.access_name(F.lower(F.left(path, F.lit(1)))).alias("access_name"),
        paths.same_source_dest(F.col("drive_id"), F.concat(path, F.lit("/")), F.lit(3), path)
        .alias("same_source_dest"),
    )


def access_levels(t: Tables) -> DataFrame:
    held = access.with_access_levels(t.listing(), t.archive_rule(), USER, ROLES)
    return held.withColumn("access_levels", F.array_join("access_levels", ","))


def catalog_query(t: Tables) -> DataFrame:
    seen = access.catalog_query(
        t.listing(), t.archive_rule(), USER, ROLES, start="A/", recursive=True, pattern=".*[05](/|[.].*)?"
    )
    return seen.select("drive_id", "path", F.array_join("access_levels", ",").alias("access_levels"))


def rule_match(t: Tables) -> DataFrame:
    matched = access.matching_rules(t.drive_item(), t.drive_security_rule())
    return matched.withColumn("rule_ids", F.array_join("rule_ids", ","))


def rule_ancestor(t: Tables) -> DataFrame:
    return access.folders_above_rules(t.listing(), t.drive_security_rule())


def drives_for_role(t: Tables) -> DataFrame:
    user = "Customer#000000011"
    parts = [
        drives.drives_for_role(t.drive(), t.drive_user(), user, role).select(
            F.lit(role).alias("role"), "drive_id"
        )
        for role in ("ADMIN", "DRIVE_ADMIN", "USER")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def any_exists(t: Tables) -> DataFrame:
    requests = t.path_request().drop("request_id").withColumnRenamed("order_id", "request_id")
    return lookup.any_exists(t.drive_item(), requests)


def get_item(t: Tables) -> DataFrame:
    path = F.col("path")
    requests = t.path_request().withColumn(
        "path", F.when(path.endswith(".CSV"), F.lower(path)).otherwise(path)
    )
    return lookup.get_items(_sized_listing(t), requests)


def conflict_join(t: Tables) -> DataFrame:
    wanted = t.transfer_spec().select(
        F.col("dest_drive_id").alias("drive_id"),
        paths.remove_both_slashes(F.col("dest_path")).alias("key"),
    )
    return lookup.existing_keys(t.drive_item(), wanted)


def any_transfer(resolution: str) -> Callable[[Tables], DataFrame]:
    return lambda t: transfer.transfer_plan(
        t.transfer_spec(), t.drive_item(), t.drive(), t.drive_security_rule(), USER, ROLES, resolution
    )


def transfer_sequence(t: Tables) -> DataFrame:
    return sequence.transfer_sequence(
        t.request_batch(), t.drive_item(), t.drive(), t.drive_security_rule(), USER, ROLES
    ).drop("stage")


def items_by_path(t: Tables) -> DataFrame:
    specs = transfer.transfer_validate(
        t.transfer_spec(), t.drive(), t.drive_security_rule(), USER, ROLES
    ).where(F.col("reason").isNull())
    covered = transfer.covered_items(specs.drop("reason"), t.drive_item())
    rows = covered.select("spec_id", F.col("item_path").alias("source_path"))
    return transfer.items_by_path(materialize(rows, "plan-rows"))


def delete_order(t: Tables) -> DataFrame:
    """Order of deletion when the folder ``A/`` of every drive goes."""
    listing = _full_listing(t)
    requests = t.drive().select(
        F.col("drive_id").alias("request_id"), "drive_id", F.lit("A/").alias("path")
    )
    rules = t.drive().select(
        "drive_id", F.lit(1).alias("rule_id"), F.lit(".*").alias("rule_text"),
        F.lit(False).alias("exclude"), F.lit("D").alias("access_level"),
        F.lit("").alias("users"), F.lit("").alias("role_name"),
    )
    plan = removal.delete_plan(requests, listing, rules, USER)
    return plan.where("decision = 'delete'").select("drive_id", "path", "ordinal")


def expiry_plan(t: Tables) -> DataFrame:
    items = t.drive_item()
    need = items.groupBy("drive_id").agg(F.sum("file_size").alias("all")).select(
        "drive_id",
        F.lit(0).cast("bigint").alias("free_bytes"),
        F.expr("all * (drive_id % 6) div 10").alias("need_bytes"),
    )
    return expiry.expiry_plan(items, need, NOW, TEMP_PREFIX)


def snapshot_retention(t: Tables) -> DataFrame:
    return usage.retention_flags(t.memory_usage()).select(
        "drive_id", "path", _stamp("created"), "expired"
    )


def audit_duration(t: Tables) -> DataFrame:
    later = F.col("created").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, bytes_transferred / 1000)")
    events = t.action_audit().withColumn("updated", later)
    return audit.with_duration(events).select("action_audit_id", "duration_ms")


def latest_status(t: Tables) -> DataFrame:
    events = t.action_audit().select(
        "username",
        F.struct("created", "action_audit_id").alias("updated"),
        "status",
        "action_audit_id",
    )
    return audit.latest_status(events, "username", "updated").drop("updated")


# --- streams ----------------------------------------------------------------


def _stream_of(t: Tables, name: str) -> DataFrame:
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}*.parquet")


def stream_audit_statistics(t: Tables) -> DataFrame:
    events = t.action_audit(_stream_of(t, "events"))
    counts = jobs.stream_audit_statistics(events).select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "action", "status", "actions"
    )
    return jobs.drain_to_table(counts, "audit-statistics")


def stream_assemble_chunks(t: Tables) -> DataFrame:
    """Uploads begin hour by hour; every fifth rests for three hours and so is abandoned once."""
    folder = shared_folder(t.spark, "chunks")
    rests = (F.col("file_uid") % 5 == 0) & (F.col("chunk_index") >= 1)
    second = (F.col("file_uid") % 48) * 3600 + F.col("chunk_index") + F.when(rests, 10_800).otherwise(0)
    arrived = F.timestamp_seconds(F.lit(1_704_067_200) + second)
    t.upload_chunk().withColumn("arrived", arrived).write.parquet(folder)
    schema = t.spark.read.parquet(folder).schema
    chunks = t.spark.readStream.schema(schema).parquet(folder)
    table = shared_folder(t.spark, "upload-status")
    jobs.stream_uploads(chunks, f"{table}/result", f"{table}/checkpoint").awaitTermination()
    uploads = jobs.read_uploads(t.spark, f"{table}/result")
    return uploads.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


def _registry() -> dict[str, Callable[[Tables], DataFrame]]:
    f = grid.GridFilter
    spec = grid.GridSpec
    copies = f("action", "eq", "copy")
    rules = lambda t: t.drive_security_rule()
    return {
        # scans, sources, sinks
        "scan_catalog": scan_catalog,
        "normalize_items": normalize_items,
        "list_one_level": lambda t: query.list_one_level(t.drive_item(), "A/F/p1")
        .unionByName(query.list_one_level(t.drive_item(), "/A/F"))
        .select("drive_id", "path", "file_size", "directory"),
        "infer_parquet_schema": infer_parquet_schema,
        "schema_to_hive": schema_to_hive,
        "infer_csv_schema": infer_csv_schema,
        "external_table": external_table,
        "external_table_csv": external_table_csv,
        "hive_location": lambda t: drives.with_location(
            t.drive_item(), t.drive(), t.drive_property()
        ).select("drive_id", "path", "location"),
        "write_usage_snapshot": write_usage_snapshot,
        "stored_usage": stored_usage,
        "folded_rollup": folded_rollup,
        "write_usage_history": write_usage_history,
        "audit_sink": audit_sink,
        # projections, filters, predicates
        "query_items": lambda t: query.query_items(
            t.drive_item(), "/A/F", recursive=True, pattern=".*[.](csv|txt)"
        ).select("drive_id", "path"),
        "query_items_level": lambda t: query.query_items(t.listing(), "A/F/"),
        "flt_not_root": _listing(query.not_root),
        "flt_level": _listing(lambda: query.at_level("/A/F")),
        "flt_not_self": _listing(lambda: query.not_self("A/F")),
        "flt_placeholder": _listing(lambda: query.not_placeholder("p7")),
        "flt_inside": _listing(lambda: query.inside("A/F")),
        "flt_pattern_path": _listing(lambda: query.path_matches("A/[FO]/p1[0-9]?/.*")),
        "flt_pattern_name": _listing(lambda: query.name_matches("o[0-9]+-1.*|p[0-9]")),
        "grid_contains": _grid(f("message", "contains", "lick")),
        "grid_doesnotcontain": _grid(f("message", "doesnotcontain", "lick")),
        "grid_eq": _grid(copies),
        "grid_neq": _grid(f("message", "neq", "")),
        "grid_startswith": _grid(f("username", "startswith", "user1")),
        "grid_endswith": _grid(f("path", "endswith", "9.csv")),
        "grid_isnull": _grid(f("message", "isnull")),
        "grid_isnotnull": _grid(f("message", "isnotnull")),
        "grid_isempty": _grid(f("message", "isempty")),
        "grid_isnotempty": _grid(f("message", "isnotempty")),
        "grid_created_day": _grid(f("created", "eq", "2024-01-10")),
        "grid_drive_in": _grid(f("drive.driveId", "contains", 2)),
        "grid_and": _grid(
            copies, f("username", "startswith", "user1"), f("message", "contains", "k")
        ),
        "grid_page": lambda t: grid.grid(
            t.action_audit(), spec("message", "asc", 100, 150, [copies])
        ).select("action_audit_id", "message"),
        "grid_sort": lambda t: grid.grid(
            t.action_audit(), spec("drive.driveId", "desc", 0, 500)
        ).select("action_audit_id", "drive_id"),
        "grid_total": lambda t: grid.grid_total(t.action_audit(), spec("created", filters=[copies])),
        "mask_audit": lambda t: audit.mask_audit(t.action_audit()).select(
            "action_audit_id", "username", "message"
        ),
        "project_public_drive": lambda t: drives.public_drives(
            t.drive().withColumn("users", F.lit("hidden"))
        ),
        "audit_between_status": lambda t: audit.audit_statistics(
            t.action_audit(), "E", "2024-01-05 00:00:00"
        ).select(F.lit("E").alias("status"), "*").unionByName(
            audit.audit_statistics(t.action_audit(), "U", "2024-01-05 00:00:00").select(
                F.lit("U").alias("status"), "*"
            )
        ),
        # joins
        "access_filter": lambda t: access.access_filter(t.listing(), rules(t), USER, ROLES),
        "rule_match": rule_match,
        "rule_ancestor": rule_ancestor,
        "rule_applies": lambda t: access.applicable_rules(rules(t), USER, ROLES).select(
            "drive_id", "rule_id"
        ),
        "access_levels": access_levels,
        "catalog_query": catalog_query,
        "readable_drives": lambda t: drives.readable_drives(t.drive(), rules(t), "cid").select(
            "drive_id", "display_name"
        ),
        "drives_of_user": lambda t: drives.drives_of_user(
            t.drive(), t.drive_user(), "Customer#000000007"
        ).select("drive_id", "display_name"),
        "drives_for_role": drives_for_role,
        "audit_with_drive": lambda t: audit.audit_with_drive(t.action_audit(), t.drive()).select(
            "action_audit_id", "action", "display_name", "drive_type"
        ),
        "any_exists": any_exists,
        "path_exists": lambda t: lookup.path_exists(t.drive_item(), t.path_request()),
        "get_item": get_item,
        "drive_properties": lambda t: drives.drive_properties(t.drive(), t.drive_property()),
        "class_lookup": lambda t: drives.with_storage_class(t.drive_item(), t.drive()).select(
            "drive_id", "path", "drive_type", "display_text", "restore_required", "is_default"
        ),
        "conflict_join": conflict_join,
        # aggregations
        "last_completed": lambda t: usage.last_completed(t.memory_usage()).select(
            "drive_id", _stamp("last_completed")
        ),
        "current_usage": lambda t: usage.current_usage(t.memory_usage()).select(
            "drive_id", "path", "bytes", _stamp("created")
        ),
        "folder_usage_total": lambda t: usage.folder_usage_total(t.memory_usage(), DRIVE, "A/F/"),
        "subfolder_usage": lambda t: usage.subfolder_usage(t.memory_usage(), DRIVE, "/A/F"),
        "usage_rollup": lambda t: usage.usage_rollup(t.memory_usage()),
        "drive_total": lambda t: usage.drive_totals(
            t.memory_usage().where(F.col("created") == F.lit("2024-01-01 00:00:00").cast("timestamp"))
        ),
        "audit_statistics": lambda t: audit.audit_statistics(
            t.action_audit(), "S", "2024-01-05 00:00:00"
        ),
        "transfer_count": lambda t: transfer.transfer_counts(t.transfer_spec(), t.drive_item()),
        "any_archived": lambda t: transfer.any_archived(
            t.transfer_spec(), t.drive_item(), t.drive()
        ),
        "temp_space": lambda t: expiry.temp_space(t.drive_item(), TEMP_PREFIX, NOW, 720),
        # windows
        "history_sample": lambda t: usage.usage_history(
            t.drive_usage_history(), "1993-01-01", "1998-06-30", 40
        ).select("drive_id", _day("created", "day"), "bytes"),
        "history_range": lambda t: usage.usage_history(
            t.drive_usage_history(), "1993-01-01", "1998-06-30"
        ).select("drive_id", _day("created", "day"), "bytes"),
        "latest_pending": lambda t: audit.latest_matching(t.action_audit()).select(
            "action_audit_id", *audit.MATCH_KEYS
        ),
        "latest_status": latest_status,
        "transfer_progress": lambda t: audit.transfer_progress(
            t.drive_item().select("drive_id", "path"), "drive_id"
        ),
        "audit_duration": audit_duration,
        # sorts and top-k
        "biggest_files": lambda t: usage.biggest_files(t.memory_usage(), DRIVE).select(
            "drive_id", "path", "bytes"
        ),
        "recent_actions": lambda t: audit.recent_actions(t.action_audit(), "user7").select(
            "action_audit_id", "action", "path", "message"
        ),
        "in_progress": lambda t: audit.in_progress(t.action_audit(), "user7").select(
            "action_audit_id", "action", "message"
        ),
        "drives_by_name": lambda t: drives.list_drives(t.drive()).select("drive_id", "display_name"),
        "items_by_path": items_by_path,
        "delete_order": delete_order,
        # set operations
        "union_prefixes": lambda t: query.with_prefix_folders(t.drive_item(), "A/F").select(
            "drive_id", "path"
        ),
        "distinct_items": lambda t: query.distinct_items(t.listed_item()).select(
            "drive_id", "path", "file_size", _day("modified_date", "modified_day"), "storage_class"
        ),
        "distinct_drives": lambda t: drives.distinct_drives(t.drive_user(), "Customer#000000007"),
        "distinct_history": lambda t: usage.usage_history(t.drive_usage_history()).select(
            "drive_id", _day("created", "day"), "bytes"
        ),
        "ancestor_closure": lambda t: query.ancestor_closure(t.drive_item()),
        # scalar functions
        "path_profile": lambda t: query.path_profile(t.path_sample()),
        "value_profile": value_profile,
        # content jobs
        "top_lines": lambda t: content.top_lines(t.raw("documents"), "doc_id", "text", 3),
        "first_line": lambda t: content.first_line(t.raw("documents"), "doc_id", "text"),
        "preview": lambda t: content.preview(t.raw("documents"), "doc_id", "text", 3, 2),
        "file_lines": file_lines,
        "file_top_lines": file_top_lines,
        "file_preview": file_preview,
        "byte_range": byte_range,
        "extract_archives": extract_archives,
        "chunk_manifest": lambda t: content.chunk_manifest(
            t.drive_item().withColumn("file_size", F.col("file_size") * 1000)
        ),
        "assemble_chunks": lambda t: content.assemble_chunks(t.upload_chunk()).select(
            "file_uid", "segment", "file_bytes", "content"
        ),
        "upload_status": lambda t: content.upload_status(t.upload_chunk()),
        "bulk_copy": bulk_copy,
        # streams
        "stream_audit_statistics": stream_audit_statistics,
        "stream_assemble_chunks": stream_assemble_chunks,
        "stream_catalog": stream_catalog,
        "stream_usage_history": stream_usage_history,
        # plans
        "transfer_validate": lambda t: transfer.transfer_validate(
            t.transfer_spec(), t.drive(), rules(t), USER, ROLES
        ).select("spec_id", "source_drive_id", "dest_drive_id", "reason"),
        "transfer_plan": any_transfer("cancel"),
        "transfer_plan_overwrite": any_transfer("overwrite"),
        "transfer_plan_skip": any_transfer("skip"),
        "transfer_sequence": transfer_sequence,
        "rename_plan": lambda t: transfer.rename_plan(
            t.transfer_spec(), t.drive_item(), t.drive(), rules(t), USER, ROLES
        ),
        "delete_plan": lambda t: removal.delete_plan(
            t.change_request().drop("new_class"), _full_listing(t), rules(t), USER, ROLES
        ),
        "storage_class_plan": lambda t: archive.storage_class_plan(
            t.change_request(), t.drive_item(), t.drive(), t.archive_rule(), USER, ROLES
        ),
        "restore_plan": lambda t: archive.restore_plan(
            t.change_request().drop("new_class"), t.drive_item(), t.drive(), t.archive_rule(),
            USER, ROLES,
        ),
        "snapshot_retention": snapshot_retention,
        "expiry_plan": expiry_plan,
    }


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query as a callable of (session, folder of the raw tables)."""

    def bind(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(Tables(spark, sf_dir))

        return run

    return {name: bind(build) for name, build in _registry().items()}
