"""The catalog tables and the registered queries as SQL, for cross-checking.

Every text is self-contained: the derived tables come along as WITH clauses over
the raw tables.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

# name -> (tables it needs, definition)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "drive": ((), """
        SELECT n_nationkey AS drive_id, n_name AS display_name,
          CASE n_regionkey WHEN 0 THEN 'Blob' WHEN 1 THEN 'GCS' WHEN 2 THEN 'S3' WHEN 3 THEN 'SMB'
            ELSE 'Windows' END AS drive_type
        FROM nation"""),
    "drive_user": ((), """
        SELECT CAST(c_custkey AS INT) AS user_id, c_name AS user_name, c_nationkey AS drive_id
        FROM customer"""),
    "listed_item": ((), """
        SELECT CAST(l_suppkey % 25 AS INT) AS drive_id,
          l_returnflag || '/' || l_linestatus || '/p' || CAST(l_partkey % 50 AS VARCHAR) || '/o'
            || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
            || CASE l_linenumber % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.parquet' WHEN 2 THEN '.avro'
               ELSE '.txt' END AS path,
          CAST(l_quantity AS BIGINT) * 1024 AS file_size, l_shipdate AS modified_date,
          CASE WHEN l_discount > 0.08 THEN 'GLACIER' ELSE 'STANDARD' END AS storage_class
        FROM lineitem"""),
    "drive_item": (("listed_item",), """
        SELECT drive_id, path, MAX(file_size) AS file_size, MAX(modified_date) AS modified_date,
          FALSE AS directory, MAX(storage_class) AS storage_class
        FROM listed_item GROUP BY drive_id, path"""),
    "memory_usage": (("drive", "drive_item"), """
        SELECT drive_id, path, file_size AS bytes, TIMESTAMP '2024-01-01 01:00:00' AS created
        FROM drive_item
        UNION ALL SELECT drive_id, path, file_size, TIMESTAMP '2024-01-01 00:00:00'
        FROM drive_item WHERE file_size < 20480
        UNION ALL SELECT drive_id, '///COMPLETED///', CAST(0 AS BIGINT),
          TIMESTAMP '2024-01-01 00:00:00' FROM drive
        UNION ALL SELECT drive_id, '///COMPLETED///', CAST(0 AS BIGINT),
          TIMESTAMP '2024-01-01 01:00:00' FROM drive WHERE drive_id <> 24"""),
    "cutoff": (("memory_usage",), """
        SELECT drive_id, MAX(created) AS last_completed,
          MAX(created) - INTERVAL 60 SECOND AS cutoff
        FROM memory_usage WHERE path = '///COMPLETED///' GROUP BY drive_id"""),
    "visible": (("memory_usage", "cutoff"), """
        SELECT u.drive_id, u.path, u.bytes, u.created FROM memory_usage u
        JOIN cutoff c ON c.drive_id = u.drive_id
        WHERE u.created > c.cutoff AND u.path <> '///COMPLETED///'"""),
    "drive_usage_history": ((), """
        SELECT CAST(o_custkey % 25 AS INT) AS drive_id, o_orderdate AS created,
          CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes
        FROM orders GROUP BY 1, 2"""),
    "action_audit": ((), """
        SELECT event_id AS action_audit_id, 'user' || CAST(user_id AS VARCHAR) AS username,
          CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'preview'
            WHEN 'purchase' THEN 'copy' WHEN 'signup' THEN 'upload' ELSE 'delete' END AS action,
          CASE WHEN event_id % 10 = 0 THEN 'E' WHEN event_id % 10 = 1 THEN 'U'
            WHEN event_id % 10 = 2 THEN 'P' ELSE 'S' END AS status,
          CASE WHEN event_id % 11 = 0 THEN 'task'
            ELSE 'A/F/o' || CAST(event_id AS VARCHAR) || '.csv' END AS path,
          CASE WHEN user_id % 26 = 25 THEN NULL ELSE CAST(user_id % 26 AS INT) END AS drive_id,
          CASE WHEN event_type = 'purchase' THEN 'R/F/u' || CAST(user_id AS VARCHAR) || '/' END AS dest_path,
          CASE WHEN event_type = 'purchase' THEN CAST(event_id % 5 AS INT) END AS dest_drive_id,
          CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN ''
            ELSE event_type || ' ' || props END AS message,
          event_id % 3 = 0 AS use_message,
          CAST(FLOOR(value * 1000) AS BIGINT) AS bytes_transferred, ts AS created
        FROM events"""),
    "drive_security_rule": (("drive",), """
        SELECT d.drive_id, r.rule_id, r.rule_text, r.exclude, r.access_level, r.users, r.role_name
        FROM drive d CROSS JOIN (VALUES
          (1, 'A/.*', FALSE, 'D', '', ''), (2, 'N/O/.*', FALSE, 'R', '', 'CatalogReaders'),
          (3, '.*[.]avro', TRUE, 'D', '', ''), (4, 'R/F/p1/.*', FALSE, 'C', 'ann;bob', ''))
          AS r(rule_id, rule_text, exclude, access_level, users, role_name)"""),
    "archive_rule": (("drive", "drive_security_rule"), """
        SELECT * FROM drive_security_rule
        UNION ALL SELECT d.drive_id, r.rule_id, r.rule_text, r.exclude, r.access_level, r.users,
          r.role_name
        FROM drive d CROSS JOIN (VALUES (5, '[AN]/.*', FALSE, 'A', '', ''),
          (6, '(A|R)/F/.*', FALSE, 'U', 'ann', ''))
          AS r(rule_id, rule_text, exclude, access_level, users, role_name)"""),
    "drive_property": (("drive",), """
        SELECT drive_id, CASE drive_type WHEN 'Blob' THEN 'BlobContainerName'
            WHEN 'GCS' THEN 'GoogleBucketName' WHEN 'S3' THEN 'BucketName' ELSE 'DriveName' END
            AS property_key,
          'store' || CAST(drive_id AS VARCHAR) AS property_value FROM drive
        UNION ALL SELECT drive_id, 'BlobConnectionString',
          'DefaultEndpointsProtocol=https;AccountName=acct' || CAST(drive_id AS VARCHAR)
            || ';EndpointSuffix=core.example.net' FROM drive WHERE drive_type = 'Blob'
        UNION ALL SELECT drive_id, 'Region', 'us-east-1' FROM drive WHERE drive_type = 'S3'"""),
    "upload_chunk": ((), """
        SELECT conv_id AS file_uid, turn AS chunk_index,
          MAX(turn) OVER (PARTITION BY conv_id) + 1 AS total_chunks, text AS data
        FROM conversations"""),
    "folder": (("drive_item",), """
        SELECT DISTINCT drive_id, split_part(path, '/', 1) || '/' AS path FROM drive_item
        UNION SELECT drive_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/'
        FROM drive_item
        UNION SELECT drive_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/'
          || split_part(path, '/', 3) || '/' FROM drive_item"""),
    "listing": (("drive_item", "folder"), """
        SELECT drive_id, path FROM drive_item UNION ALL SELECT drive_id, path FROM folder
        UNION ALL SELECT DISTINCT drive_id, '/' FROM drive_item"""),
    "path_sample": (("listing",), """
        SELECT drive_id, path FROM listing
        UNION SELECT drive_id, '/' || path FROM listing
        UNION SELECT drive_id, 'C:/' || path FROM listing
        UNION SELECT drive_id, 'd:\\' || replace(path, '/', '\\') FROM listing
        UNION SELECT CAST(page_id % 25 AS INT), url FROM pages"""),
    "path_request": (("drive_item",), """
        SELECT regexp_extract(path, 'o([0-9]+)-', 1) AS order_id,
          CAST(drive_id AS VARCHAR) || ':' || path AS request_id, drive_id,
          CASE WHEN ends_with(path, '.csv')
              THEN '/' || regexp_extract(path, '^(.*/)[^/]*$', 1) || upper(split_part(path, '/', -1))
            WHEN ends_with(path, '.parquet') THEN regexp_extract(path, '^(.*)/[^/]*$', 1)
            WHEN ends_with(path, '.avro') THEN path || '/' ELSE 'Z/' || path END AS path
        FROM drive_item"""),
    "folder_files": (("drive_item",), """
        SELECT drive_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder,
          MIN(path) AS first_path, MAX(path) AS last_path,
          CAST(regexp_extract(ANY_VALUE(path), '/p([0-9]+)/', 1) AS INT) AS pn
        FROM drive_item GROUP BY 1, 2"""),
    "transfer_spec": (("folder_files",), """
        SELECT 'd:' || drive_id || ':' || folder AS spec_id, drive_id AS source_drive_id,
          CASE WHEN pn % 4 = 1 THEN rtrim(folder, '/') ELSE folder END AS source_path,
          CASE WHEN pn % 5 = 0 THEN drive_id WHEN pn % 5 = 1 THEN 99 ELSE (drive_id + 1) % 25 END
            AS dest_drive_id,
          CASE WHEN pn % 10 = 0 THEN folder WHEN pn % 15 = 0 THEN folder || 'sub/'
            WHEN pn % 7 = 3 THEN NULL WHEN pn % 11 = 4 THEN 'X/in/p' || pn || '/'
            WHEN pn % 5 = 2 THEN 'A/O/p' || pn || '/' ELSE 'A/N/in/p' || pn || '/' END AS dest_path,
          pn % 3 = 0 AS remove_source
        FROM folder_files
        UNION ALL SELECT 'f:' || drive_id || ':' || first_path, drive_id, first_path,
          CASE WHEN pn % 3 = 1 THEN (drive_id + 1) % 25 ELSE drive_id END,
          CASE WHEN pn % 5 = 2 THEN last_path
            ELSE 'A/N/files/' || split_part(first_path, '/', -1) END, pn % 2 = 0
        FROM folder_files"""),
    "change_request": (("folder_files",), """
        SELECT drive_id || ':' || path AS request_id, drive_id, path,
          CASE pn % 4 WHEN 0 THEN 'GLACIER' WHEN 1 THEN 'NEARLINE' WHEN 2 THEN 'COOL'
            ELSE 'STANDARD_IA' END AS new_class
        FROM (SELECT drive_id, folder AS path, pn FROM folder_files
              UNION ALL SELECT drive_id, first_path, pn FROM folder_files)"""),
    "storage_class": ((), """
        SELECT * FROM (VALUES
          ('S3', 'STANDARD', 'Standard', FALSE, TRUE), ('S3', 'STANDARD_IA', 'Standard-IA', FALSE, FALSE),
          ('S3', 'ONEZONE_IA', 'OneZone-IA', FALSE, FALSE),
          ('S3', 'INTELLIGENT_TIERING', 'Intelligent', FALSE, FALSE),
          ('S3', 'GLACIER', 'Glacier', TRUE, FALSE), ('S3', 'DEEP_ARCHIVE', 'Deep Archive', TRUE, FALSE),
          ('S3', 'REDUCED_REDUNDANCY', 'Reduced Redundancy', FALSE, FALSE),
          ('Blob', 'HOT', 'Hot', FALSE, TRUE), ('Blob', 'COOL', 'Cool', FALSE, FALSE),
          ('Blob', 'ARCHIVE', 'Archive', TRUE, FALSE), ('GCS', 'ARCHIVE', 'Archive', FALSE, FALSE),
          ('GCS', 'COLDLINE', 'Cold Line', FALSE, FALSE), ('GCS', 'NEARLINE', 'Near Line', FALSE, FALSE),
          ('GCS', 'STANDARD', 'Standard', FALSE, TRUE))
          AS c(drive_type, storage_class, display_text, restore_required, is_default)"""),
}

GIVERS = {"R": "RCMD", "C": "CMD", "M": "MD", "D": "D", "A": "A", "U": "U"}


def held(level: str, drive: str, path: str, rules: str = "drive_security_rule") -> str:
    """Whether user ann in role catalogreaders holds `level` on (drive, path)."""
    givers = ", ".join(f"'{c}'" for c in GIVERS[level])
    applies = f"""r.drive_id = {drive} AND r.access_level IN ({givers})
        AND (r.users = '' OR list_contains(string_split(r.users, ';'), 'ann'))
        AND (r.role_name = '' OR lower(r.role_name) = 'catalogreaders')"""
    matched = f"regexp_full_match({path}, r.rule_text)"
    ancestor = f" OR (starts_with(r.rule_text, {path}) AND ends_with({path}, '/'))"
    allowed = f"({matched}{ancestor if level == 'R' else ''})"
    return f"""(EXISTS (SELECT 1 FROM {rules} r WHERE {applies} AND NOT r.exclude AND {allowed})
        AND NOT EXISTS (SELECT 1 FROM {rules} r WHERE {applies} AND r.exclude AND {matched}))"""


TABLES["spec_access"] = (("transfer_spec", "drive_security_rule"), f"""
        SELECT s.*, {held('R', 's.source_drive_id', 's.source_path')} AS source_r,
          {held('D', 's.source_drive_id', 's.source_path')} AS source_d,
          {held('C', 's.dest_drive_id', 's.dest_path')} AS dest_c
        FROM transfer_spec s""")

TABLES["spec_checked"] = (("spec_access", "drive"), """
        SELECT s.*, sd.drive_type AS source_type,
          CASE WHEN sd.drive_id IS NULL THEN 'no source drive'
            WHEN dd.drive_id IS NULL THEN 'no destination drive'
            WHEN dest_path IS NULL THEN 'no destination path'
            WHEN source_path IS NULL THEN 'no source path'
            WHEN source_drive_id = dest_drive_id
              AND (source_path = dest_path OR source_path = dest_path || '/')
              THEN 'same source and destination'
            WHEN remove_source AND source_drive_id = dest_drive_id AND (trim(source_path, '/') = ''
              OR starts_with(trim(dest_path, '/'), trim(source_path, '/') || '/'))
              THEN 'moved beneath itself'
            WHEN NOT ((CASE WHEN remove_source THEN source_d ELSE source_r END) AND dest_c)
              THEN 'no permission' END AS reason
        FROM spec_access s LEFT JOIN drive sd ON sd.drive_id = source_drive_id
        LEFT JOIN drive dd ON dd.drive_id = dest_drive_id""")

TABLES["item_parent"] = (("drive_item",), """
        SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM drive_item""")

TABLES["spec_item"] = (("transfer_spec", "item_parent"), """
        SELECT s.spec_id, i.path AS item_path, i.file_size AS item_size,
          i.storage_class AS item_class, FALSE AS in_folder, s.dest_path AS item_dest
        FROM transfer_spec s JOIN item_parent i ON i.drive_id = s.source_drive_id
          AND i.path = s.source_path
        UNION ALL SELECT s.spec_id, i.path, i.file_size, i.storage_class, TRUE,
          rtrim(s.dest_path, '/') || '/' || split_part(i.path, '/', -1)
        FROM transfer_spec s JOIN item_parent i ON i.drive_id = s.source_drive_id
          AND i.parent = rtrim(s.source_path, '/')""")

TABLES["spec_covered"] = (("spec_checked", "spec_item", "storage_class"), """
        SELECT s.*, i.item_path, i.item_size, i.in_folder, i.item_dest,
          COALESCE(c.restore_required, FALSE) AS archived
        FROM spec_checked s JOIN spec_item i ON i.spec_id = s.spec_id
        LEFT JOIN storage_class c ON c.drive_type = s.source_type AND c.storage_class = i.item_class
        WHERE s.reason IS NULL""")

TABLES["existing"] = (("drive_item", "folder"), """
        SELECT drive_id, path AS bare FROM drive_item
        UNION SELECT drive_id, rtrim(path, '/') FROM folder""")

TABLES["spec_found"] = (("spec_covered", "existing"), """
        SELECT s.*, e.bare IS NOT NULL OR ROW_NUMBER() OVER (
            PARTITION BY s.dest_drive_id, s.item_dest ORDER BY s.spec_id, s.item_path) > 1 AS dest_there
        FROM spec_covered s
        LEFT JOIN existing e ON e.drive_id = s.dest_drive_id AND e.bare = s.item_dest""")

TABLES["spec_verdict"] = (("spec_checked", "spec_found", "existing"), """
        SELECT s.spec_id, COALESCE(BOOL_OR(f.archived), FALSE) AS any_archived,
          COALESCE(BOOL_OR(f.dest_there), FALSE) AS any_conflict,
          COALESCE(BOOL_OR(f.in_folder AND e.bare IS NOT NULL), FALSE) AS folder_there,
          COUNT(f.item_path) AS items
        FROM spec_checked s LEFT JOIN spec_found f ON f.spec_id = s.spec_id
        LEFT JOIN existing e ON e.drive_id = s.dest_drive_id AND e.bare = rtrim(s.dest_path, '/')
        WHERE s.reason IS NULL GROUP BY s.spec_id""")


def _transfer_plan(resolution: str) -> str:
    cancel = "any_conflict OR folder_there" if resolution == "cancel" else "FALSE"
    skip = "f.dest_there" if resolution == "skip" else "FALSE"
    replaces = "f.dest_there" if resolution == "overwrite" else "FALSE"
    return with_tables(f"""
        , final AS (SELECT s.*, CASE WHEN s.reason IS NOT NULL THEN s.reason
            WHEN v.items = 0 THEN 'source not found' WHEN v.any_archived THEN 'archived'
            WHEN {cancel} THEN 'destination exists' END AS why
          FROM spec_checked s LEFT JOIN spec_verdict v ON v.spec_id = s.spec_id)
        SELECT f.spec_id, f.source_drive_id, f.item_path AS source_path, f.dest_drive_id,
          f.item_dest AS dest_path, f.item_size AS file_size,
          CASE WHEN {skip} THEN 'skip' ELSE 'transfer' END AS decision,
          CASE WHEN {skip} THEN NULL WHEN f.item_size = 0 THEN 'empty'
            WHEN f.source_drive_id = f.dest_drive_id THEN
              CASE WHEN f.remove_source AND NOT f.in_folder THEN 'rename' ELSE 'copy' END
            ELSE 'chunk' END AS method,
          {replaces} AS replaces, CAST(NULL AS VARCHAR) AS reason
        FROM spec_found f JOIN final z ON z.spec_id = f.spec_id WHERE z.why IS NULL
        UNION ALL SELECT spec_id, source_drive_id, source_path, dest_drive_id, dest_path, NULL,
          'reject', NULL, FALSE, why FROM final WHERE why IS NOT NULL
        """, "spec_checked", "spec_found", "spec_verdict")


TABLES["request_batch"] = (("item_parent",), """
        SELECT n || ':' || drive_id || ':' || folder AS spec_id, CAST(n AS INT) AS n,
          drive_id AS source_drive_id,
          CASE n WHEN '1' THEN folder WHEN '2' THEN 'A/M/' || first_path WHEN '3' THEN 'A/M/' || folder
            WHEN '4' THEN first_path ELSE 'A/M/' || last_path END AS source_path,
          CAST(CASE n WHEN '3' THEN (drive_id + 1) % 25 ELSE drive_id END AS INT) AS dest_drive_id,
          CASE n WHEN '1' THEN 'A/M/' || folder WHEN '2' THEN 'A/C/' || first_path WHEN '3' THEN folder
            WHEN '4' THEN 'A/L/' || first_path ELSE 'A/K/' || last_path END AS dest_path,
          n IN ('1', '4', '5') AS remove_source
        FROM (SELECT drive_id, parent || '/' AS folder, MIN(path) AS first_path, MAX(path) AS last_path
          FROM item_parent GROUP BY 1, 2), (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) AS v(n)""")


def _transfer_sequence() -> str:
    """Requests of one round leave each other alone; each round sees the items the one before it left."""
    rounds = []
    for k, numbers in enumerate(("1", "2, 3", "4, 5"), 1):
        rounds.append(f"""
        covered{k} AS MATERIALIZED (
          SELECT s.*, i.path AS item_path, i.file_size, i.storage_class, FALSE AS in_folder, s.dest_path AS item_dest
          FROM checked s JOIN items{k - 1} i ON i.drive_id = s.source_drive_id AND i.path = s.source_path
          WHERE s.n IN ({numbers}) AND s.why IS NULL
          UNION ALL SELECT s.*, i.path, i.file_size, i.storage_class, TRUE,
            s.dest_path || split_part(i.path, '/', -1)
          FROM checked s JOIN items{k - 1} i ON i.drive_id = s.source_drive_id
            AND regexp_extract(i.path, '^(.*/)[^/]*$', 1) = s.source_path
          WHERE s.n IN ({numbers}) AND s.why IS NULL),
        folders{k} AS (SELECT DISTINCT drive_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM items{k - 1}),
        verdict{k} AS MATERIALIZED (
          SELECT s.spec_id, CASE WHEN COUNT(c.item_path) = 0 THEN 'source not found'
              WHEN BOOL_OR(d.drive_type = 'S3' AND c.storage_class = 'GLACIER') THEN 'archived'
              WHEN BOOL_OR(e.path IS NOT NULL) OR BOOL_OR(c.in_folder AND f.folder IS NOT NULL)
                THEN 'destination exists' END AS why
          FROM checked s JOIN drive d ON d.drive_id = s.source_drive_id
          LEFT JOIN covered{k} c ON c.spec_id = s.spec_id
          LEFT JOIN items{k - 1} e ON e.drive_id = s.dest_drive_id AND e.path = c.item_dest
          LEFT JOIN folders{k} f ON f.drive_id = s.dest_drive_id AND f.folder = s.dest_path
          WHERE s.n IN ({numbers}) AND s.why IS NULL GROUP BY s.spec_id),
        done{k} AS MATERIALIZED (
          SELECT c.* FROM covered{k} c JOIN verdict{k} v ON v.spec_id = c.spec_id WHERE v.why IS NULL),
        items{k} AS MATERIALIZED (
          SELECT * FROM items{k - 1} i WHERE NOT EXISTS (SELECT 1 FROM done{k} x
            WHERE x.remove_source AND x.source_drive_id = i.drive_id AND x.item_path = i.path)
          UNION ALL SELECT dest_drive_id, item_dest, file_size, 'STANDARD' FROM done{k})""")
    done = " UNION ALL ".join(f"SELECT * FROM done{k}" for k in (1, 2, 3))
    verdicts = " UNION ALL ".join(f"SELECT * FROM verdict{k}" for k in (1, 2, 3))
    return with_tables(f"""
        , checked AS MATERIALIZED (SELECT s.*, CASE WHEN NOT (
            CASE WHEN remove_source THEN {held('D', 's.source_drive_id', 's.source_path')}
              ELSE {held('R', 's.source_drive_id', 's.source_path')} END
            AND {held('C', 's.dest_drive_id', 's.dest_path')}) THEN 'no permission' END AS why
          FROM request_batch s),
        items0 AS MATERIALIZED (SELECT drive_id, path, file_size, storage_class FROM drive_item),
        {','.join(rounds)},
        done AS ({done}), refused AS (
          SELECT spec_id, why FROM checked WHERE why IS NOT NULL
          UNION ALL SELECT spec_id, why FROM ({verdicts}) WHERE why IS NOT NULL)
        SELECT spec_id, source_drive_id, item_path AS source_path, dest_drive_id, item_dest AS dest_path, file_size,
          'transfer' AS decision, CASE WHEN file_size = 0 THEN 'empty'
            WHEN source_drive_id <> dest_drive_id THEN 'chunk'
            WHEN remove_source AND NOT in_folder THEN 'rename' ELSE 'copy' END AS method,
          FALSE AS replaces, CAST(NULL AS VARCHAR) AS reason, 1 AS step FROM done
        UNION ALL SELECT spec_id, source_drive_id, item_path, NULL, NULL, NULL, 'remove', 'delete', FALSE, NULL, 2
        FROM done WHERE remove_source AND (in_folder OR file_size = 0)
        UNION ALL SELECT s.spec_id, s.source_drive_id, s.source_path, s.dest_drive_id, s.dest_path, NULL,
          'reject', NULL, FALSE, r.why, 1 FROM checked s JOIN refused r ON r.spec_id = s.spec_id
        """, "request_batch", "drive_item", "drive", "drive_security_rule")


def with_tables(body: str, *names: str) -> str:
    """`body` with the definitions of the named tables and of all they need in front.

    A body that starts with a comma adds tables of its own.
    """
    graph: dict[str, tuple[str, ...]] = {}
    waiting = list(names)
    while waiting:
        name = waiting.pop()
        if name not in graph:
            graph[name] = TABLES[name][0]
            waiting += TABLES[name][0]
    order = TopologicalSorter(graph).static_order()
    clauses = ",\n".join(f"{name} AS ({TABLES[name][1].strip()})" for name in order)
    return f"WITH {clauses}\n{body.strip()}" if clauses else body.strip()


NAME = "split_part(CASE WHEN ends_with({0}, '/') THEN left({0}, length({0}) - 1) ELSE {0} END, '/', -1)"
NO_LAST = "CASE WHEN ends_with({0}, '/') THEN left({0}, length({0}) - 1) ELSE {0} END"
NO_FIRST = "CASE WHEN starts_with({0}, '/') THEN substr({0}, 2) ELSE {0} END"
LEVELS_TEXT = {
    "D": "Read,Create,Modify,Delete", "M": "Read,Create,Modify", "C": "Read,Create", "R": "Read",
}


def _lines(text: str) -> str:
    return (
        f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE "
        f"string_split_regex(regexp_replace({text}, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') END"
    )


def _grid(condition: str) -> str:
    return with_tables(
        f"SELECT action_audit_id, username, action, path, message FROM action_audit WHERE {condition}",
        "action_audit",
    )


def _of_listing(condition: str) -> str:
    return with_tables(f"SELECT drive_id, path FROM listing WHERE {condition}", "listing")


def _profile() -> str:
    no_last = NO_LAST.format("path")
    bare = NO_FIRST.format(f"({no_last})")
    return with_tables(
        f"""
        , a AS (SELECT drive_id, path, {NAME.format('path')} AS file_name,
          CASE WHEN strpos(path, '/') = 0 THEN '/'
            ELSE left(path, length(path) - 1 - length(split_part(path, '/', -1))) END AS parent_folder,
          {no_last} AS remove_last_slash, {NO_FIRST.format('path')} AS remove_first_slash,
          {bare} AS remove_both_slashes FROM path_sample),
        b AS (SELECT *, CASE WHEN strpos(remove_last_slash, '/') = 0 THEN '/'
            ELSE left(remove_last_slash, length(remove_last_slash) - 1
              - length(split_part(remove_last_slash, '/', -1))) END AS data_folder FROM a),
        c AS (SELECT *, CASE WHEN ends_with(data_folder, '/') THEN left(data_folder, length(data_folder) - 1)
            ELSE data_folder END AS inner_folder FROM b),
        d AS (SELECT *, CASE WHEN strpos(inner_folder, '/') = 0 THEN '/'
            ELSE left(inner_folder, length(inner_folder) - 1 - length(split_part(inner_folder, '/', -1)))
            END AS above FROM c)
        SELECT drive_id, path, file_name,
          CASE WHEN strpos(file_name, '.') = 0 THEN '' ELSE split_part(file_name, '.', -1) END AS extension,
          ends_with(path, '/') AS is_directory, parent_folder,
          CASE WHEN strpos(remove_both_slashes, '/') = 0 THEN '/' ELSE left(remove_both_slashes,
            length(remove_both_slashes) - length(split_part(remove_both_slashes, '/', -1))) END
            AS parent_folder_path,
          CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS add_first_slash,
          CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END AS add_last_slash,
          CASE WHEN path = '' THEN '/' ELSE CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END || path
            || CASE WHEN ends_with(path, '/') THEN '' ELSE '/' END END AS add_both_slashes,
          remove_first_slash, remove_last_slash, remove_both_slashes,
          replace(path, '\\', '/') AS to_unix, replace(path, '/', '\\') AS to_windows,
          regexp_matches(path, '^[A-Za-z]:[/\\\\]') AS has_drive_letter,
          CASE WHEN regexp_matches(path, '^[A-Za-z]:[/\\\\]') THEN substr(path, 4) ELSE path END
            AS remove_drive_letter,
          path IN ('', '/') AS is_root,
          CASE WHEN ends_with(above, '/') THEN above ELSE above || '/' END
            || CASE WHEN strpos(file_name, '.') = 0 THEN file_name ELSE
               left(file_name, length(file_name) - 1 - length(split_part(file_name, '.', -1))) END
            || '.avsc' AS avsc_location FROM d""",
        "path_sample",
    )


def _history(k: int) -> str:
    return with_tables(
        f"""
        , p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY drive_id ORDER BY created) - 1 AS ix,
            COUNT(*) OVER (PARTITION BY drive_id) AS n FROM drive_usage_history
          WHERE created BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-06-30'),
        q AS (SELECT *, n // {k} AS m, (n - 1) - ({k} - 1) * (n // {k}) AS s FROM p)
        SELECT drive_id, strftime(created, '%Y-%m-%d') AS day, bytes FROM q
        WHERE n <= {k} OR ix = 0 OR (ix > s AND (ix - s) % m = 0)""",
        "drive_usage_history",
    )


def texts() -> dict[str, str]:
    """The SQL of every registered query that has one."""
    access_rows = f"SELECT i.drive_id, i.path FROM listing i WHERE {held('R', 'i.drive_id', 'i.path')}"
    plain = "SELECT drive_id, path FROM drive_item"
    day = "strftime(created, '%Y-%m-%d %H:%M:%S')"
    size = "octet_length(encode(text)) + 1"  # each text is written with a line break
    total = f"SELECT CAST(SUM({size}) AS BIGINT) AS bytes FROM documents"
    per_source = f"SELECT source, CAST(SUM({size}) AS BIGINT) AS bytes FROM documents GROUP BY source"
    # the body of a file ends with a line break, which opens no other line
    shelves = """WITH body AS (SELECT doc_id // 100 AS shelf,
          string_agg(COALESCE(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
        shelf AS (SELECT shelf, string_split_regex(body, '\\r\\n|\\n|\\r')[1:-2] AS parts FROM body)"""
    break_count = "string_split_regex(text || chr(10), '\\r\\n|\\n|\\r')"
    out = {
        # scans, files and tables
        "scan_catalog": f"""SELECT 1 AS drive_id, source, CAST(SUM({size}) AS BIGINT) AS bytes
            FROM documents GROUP BY source""",
        "normalize_items": with_tables(
            """SELECT 1 AS drive_id, path, file_size, strftime(modified_date, '%Y-%m-%d') AS day,
              FALSE AS directory, storage_class FROM listed_item""", "listed_item"),
        "stream_catalog": per_source,
        "stream_usage_history": f"SELECT 1 AS drive_id, '/' AS path, d.bytes FROM ({total}) d",
        "byte_range": per_source,
        "extract_archives": per_source,
        "bulk_copy": f"SELECT 'S' AS status, d.* FROM ({per_source}) d",
        "file_top_lines": f"""{shelves} SELECT shelf, line_no, line FROM (SELECT shelf,
            UNNEST(range(len(parts))) AS line_no, UNNEST(parts) AS line FROM shelf) WHERE line_no < 5""",
        "file_preview": f"""{shelves} SELECT shelf, line FROM (SELECT shelf, len(parts) AS n,
            UNNEST(range(len(parts))) AS line_no, UNNEST(parts) AS line FROM shelf)
            WHERE line_no < 3 OR line_no >= n - 2""",
        "file_lines": f"""SELECT source, CAST(SUM(len(parts) - 1) AS BIGINT) AS lines,
              CAST(SUM(octet_length(encode(array_to_string(parts, '')))) AS BIGINT) AS bytes
            FROM (SELECT source, {break_count} AS parts FROM documents) GROUP BY source""",
        "external_table": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
            strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""",
        "external_table_csv": "SELECT * FROM customer",
        "infer_parquet_schema": _described(),
        "infer_csv_schema": _described_csv(("region", "nation", "supplier", "customer", "part", "orders", "lineitem")),
        "schema_to_hive": """SELECT * FROM (VALUES (0, 'l_orderkey', 'bigint'),
            (1, 'line', 'struct<l_linenumber:int,l_quantity:double,rates:array<double>>'),
            (2, 'shipped', 'map<string,timestamp_ntz>')) AS t(ordinal, name, type)""",
        "list_one_level": with_tables(
            f"""SELECT drive_id, path, file_size, FALSE AS directory FROM drive_item
            WHERE regexp_full_match(path, 'A/F/p1/[^/]+')
            UNION ALL SELECT DISTINCT drive_id, 'A/F/' || split_part(path, '/', 3) || '/', 0, TRUE
            FROM drive_item WHERE starts_with(path, 'A/F/')""", "drive_item"),
        "hive_location": with_tables(
            """, p AS (SELECT drive_id, MAX(CASE WHEN property_key IN ('BucketName', 'GoogleBucketName',
                'BlobContainerName') THEN property_value END) AS store FROM drive_property GROUP BY 1)
            SELECT i.drive_id, i.path,
              CASE d.drive_type WHEN 'S3' THEN 's3a://' || store || '/'
                WHEN 'GCS' THEN 'gs://' || store || '/'
                WHEN 'Blob' THEN 'wasbs://' || store || '@acct' || d.drive_id || '.blob.core.example.net/'
              END || regexp_extract(i.path, '^(.*/)[^/]*$', 1) AS location
            FROM drive_item i JOIN drive d ON d.drive_id = i.drive_id
            JOIN p ON p.drive_id = i.drive_id""", "drive_item", "drive", "drive_property"),
        "write_usage_snapshot": with_tables(
            """SELECT drive_id, COUNT(*) AS files, CAST(SUM(file_size) AS BIGINT) AS bytes, 1 AS markers
            FROM drive_item GROUP BY drive_id""", "drive_item"),
        "write_usage_history": with_tables(
            """SELECT d.drive_id, CAST(COALESCE(SUM(i.file_size), 0) AS BIGINT) AS bytes, '/' AS path
            FROM drive d LEFT JOIN drive_item i ON i.drive_id = d.drive_id GROUP BY d.drive_id""",
            "drive", "drive_item"),
        "audit_sink": with_tables(
            """SELECT action_audit_id, CASE WHEN status = 'P' THEN 'S' ELSE status END AS status,
              bytes_transferred FROM action_audit""", "action_audit"),
        # catalog query
        "query_items": with_tables(
            f"{plain} WHERE starts_with(path, 'A/F/') AND regexp_full_match(path, '.*[.](csv|txt)')",
            "drive_item"),
        "query_items_level": with_tables(
            """SELECT drive_id, path FROM listing WHERE regexp_full_match(path, 'A/F/[^/]+/?')""",
            "listing"),
        "flt_not_root": _of_listing("path NOT IN ('', '/')"),
        "flt_level": _of_listing("regexp_full_match(path, 'A/F/[^/]+/?')"),
        "flt_not_self": _of_listing("path <> 'A/F/'"),
        "flt_placeholder": _of_listing("NOT regexp_full_match(path, '(.*/)?p7/?')"),
        "flt_inside": _of_listing("starts_with(path, 'A/F/')"),
        "flt_pattern_path": _of_listing("regexp_full_match(path, 'A/[FO]/p1[0-9]?/.*')"),
        "flt_pattern_name": _of_listing("regexp_full_match(path, '(.*/)?(o[0-9]+-1.*|p[0-9])/?')"),
        # set operations
        "union_prefixes": with_tables(
            f"""{plain} WHERE starts_with(path, 'A/F/')
            UNION ALL SELECT DISTINCT drive_id, 'A/F/' || split_part(path, '/', 3) || '/'
            FROM drive_item WHERE starts_with(path, 'A/F/')""", "drive_item"),
        "distinct_items": with_tables(
            """SELECT drive_id, path, file_size, strftime(modified_date, '%Y-%m-%d') AS modified_day,
              storage_class FROM listed_item
            QUALIFY ROW_NUMBER() OVER (PARTITION BY drive_id, path
              ORDER BY modified_date DESC, file_size DESC, storage_class DESC) = 1""", "listed_item"),
        "ancestor_closure": with_tables("SELECT drive_id, path FROM folder", "folder"),
        "distinct_drives": with_tables(
            "SELECT DISTINCT drive_id FROM drive_user WHERE user_name = 'Customer#000000007'",
            "drive_user"),
        "distinct_history": with_tables(
            """SELECT DISTINCT drive_id, strftime(created, '%Y-%m-%d') AS day, bytes
            FROM drive_usage_history""", "drive_usage_history"),
        # scalar functions
        "path_profile": _profile(),
        "value_profile": with_tables(
            """SELECT drive_id, path,
              CAST(LEAST((((file_size * 5000000 - 1) // 104857600000) + 1) * 10485760, 2147483647)
                AS BIGINT) AS chunk_size,
              left(path, 8) AS safe_value, strftime(modified_date, '%Y%m%d_%H%M%S') AS timestamp_name,
              CASE WHEN storage_class <> 'GLACIER' THEN strftime(modified_date, '%m/%d/%Y %I:%M') || ' UTC'
                END AS restore_expiry,
              file_size = 0 AS is_empty, starts_with(path, 'A/F/') AS is_inside,
              path = 'A/F/p1' AS matches_path,
              CASE WHEN starts_with(path, 'A/F') THEN substr(path, 5) ELSE path END AS relative_path,
              CASE WHEN starts_with(path, 'A/F/') THEN 'Z/' || substr(path, 5) ELSE path END AS rebase_path,
              array_to_string(string_split(path, '/'), ',') AS users_list,
              CASE left(path, 1) WHEN 'A' THEN 'Archive' WHEN 'N' THEN 'None' WHEN 'R' THEN 'Read' END
                AS access_name,
              drive_id = 3 AND (path = 'x' OR path = path) AS same_source_dest
            FROM drive_item""", "drive_item"),
        # access
        "access_filter": with_tables(access_rows, "listing", "drive_security_rule"),
        "rule_match": with_tables(
            """SELECT i.drive_id, i.path, string_agg(CAST(r.rule_id AS VARCHAR), ',' ORDER BY r.rule_id) AS rule_ids
            FROM drive_item i JOIN drive_security_rule r ON r.drive_id = i.drive_id
              AND regexp_full_match(i.path, r.rule_text) GROUP BY i.drive_id, i.path""",
            "drive_item", "drive_security_rule"),
        "rule_ancestor": with_tables(
            """SELECT f.drive_id, f.path, r.rule_id FROM listing f JOIN drive_security_rule r
            ON r.drive_id = f.drive_id AND starts_with(r.rule_text, f.path) AND ends_with(f.path, '/')""",
            "listing", "drive_security_rule"),
        "rule_applies": with_tables(
            """SELECT drive_id, rule_id FROM drive_security_rule WHERE access_level IN ('R', 'C', 'M', 'D')
            AND (users = '' OR list_contains(string_split(users, ';'), 'ann'))
            AND (role_name = '' OR lower(role_name) = 'catalogreaders')""", "drive_security_rule"),
        "access_levels": with_tables(
            f"""SELECT drive_id, path, concat_ws(',',
              CASE WHEN d THEN '{LEVELS_TEXT['D']}' WHEN m THEN '{LEVELS_TEXT['M']}'
                WHEN c THEN '{LEVELS_TEXT['C']}' WHEN r THEN 'Read' END,
              CASE WHEN a THEN 'Archive' END, CASE WHEN u THEN 'Restore' END) AS access_levels
            FROM (SELECT i.drive_id, i.path, {', '.join(
                held(level, 'i.drive_id', 'i.path', 'archive_rule') + ' AS ' + level.lower()
                for level in 'DMCRAU')} FROM listing i)""", "listing", "archive_rule"),
        "catalog_query": with_tables(
            f"""SELECT drive_id, path, concat_ws(',',
              CASE WHEN d THEN '{LEVELS_TEXT['D']}' WHEN m THEN '{LEVELS_TEXT['M']}'
                WHEN c THEN '{LEVELS_TEXT['C']}' WHEN r THEN 'Read' END,
              CASE WHEN a THEN 'Archive' END, CASE WHEN u THEN 'Restore' END) AS access_levels
            FROM (SELECT i.drive_id, i.path, {', '.join(
                held(level, 'i.drive_id', 'i.path', 'archive_rule') + ' AS ' + level.lower()
                for level in 'DMCRAU')} FROM listing i
              WHERE starts_with(i.path, 'A/') AND i.path <> 'A/' AND NOT regexp_full_match(i.path, '(.*/)?[.]placeholder/?')
                AND regexp_full_match(i.path, '.*[05](/|[.].*)?')) WHERE r""", "listing", "archive_rule"),
        "readable_drives": with_tables(
            """SELECT drive_id, display_name FROM drive WHERE drive_id IN (SELECT drive_id
            FROM drive_security_rule WHERE NOT exclude AND access_level IN ('R', 'C', 'M', 'D')
              AND users = '' AND role_name = '')""", "drive", "drive_security_rule"),
        "drives_of_user": with_tables(
            """SELECT drive_id, display_name FROM drive WHERE drive_id IN (SELECT drive_id
            FROM drive_user WHERE user_name = 'Customer#000000007')""", "drive", "drive_user"),
        "drives_for_role": with_tables(
            """SELECT 'ADMIN' AS role, drive_id FROM drive
            UNION ALL SELECT 'DRIVE_ADMIN', drive_id FROM drive WHERE drive_id IN (SELECT drive_id
              FROM drive_user WHERE user_name = 'Customer#000000011')""", "drive", "drive_user"),
        "drives_by_name": with_tables("SELECT drive_id, display_name FROM drive", "drive"),
        "project_public_drive": with_tables(
            "SELECT drive_id, display_name, drive_type FROM drive", "drive"),
        "drive_properties": with_tables(
            """, k AS (SELECT * FROM (VALUES
              ('S3', 0, 'Region'), ('S3', 1, 'AccessKey'), ('S3', 2, 'AccessSecret'),
              ('S3', 3, 'BucketName'), ('S3', 4, 'HiveHostName'), ('S3', 5, 'HivePort'),
              ('Blob', 0, 'BlobConnectionString'), ('Blob', 1, 'BlobContainerName'),
              ('Blob', 2, 'HiveHostName'), ('Blob', 3, 'HivePort'),
              ('GCS', 0, 'GoogleBucketName'), ('GCS', 1, 'ProjectId'), ('GCS', 2, 'GCSCredentials'),
              ('GCS', 3, 'HiveHostName'), ('GCS', 4, 'HivePort'),
              ('SMB', 0, 'HostName'), ('SMB', 1, 'Domain'), ('SMB', 2, 'UserName'),
              ('SMB', 3, 'Password'), ('SMB', 4, 'ShareName'), ('Windows', 0, 'DriveName'))
              AS v(drive_type, ordinal, property_key))
            SELECT d.drive_id, k.ordinal, k.property_key, p.property_value FROM drive d
            JOIN k ON k.drive_type = d.drive_type
            LEFT JOIN drive_property p ON p.drive_id = d.drive_id AND p.property_key = k.property_key""",
            "drive", "drive_property"),
        "class_lookup": with_tables(
            """SELECT i.drive_id, i.path, d.drive_type, c.display_text,
              COALESCE(c.restore_required, FALSE) AS restore_required,
              COALESCE(c.is_default, FALSE) AS is_default
            FROM drive_item i JOIN drive d ON d.drive_id = i.drive_id
            LEFT JOIN storage_class c ON c.drive_type = d.drive_type
              AND c.storage_class = i.storage_class""", "drive_item", "drive", "storage_class"),
        # lookups
        "any_exists": with_tables(
            """, known AS (SELECT drive_id, regexp_extract('/' || bare, '^(.*/)[^/]*$', 1) AS parent,
                lower(split_part(bare, '/', -1)) AS name FROM existing),
            wanted AS (SELECT order_id AS request_id, drive_id,
                regexp_extract('/' || trim(path, '/'), '^(.*/)[^/]*$', 1) AS parent,
                lower(split_part(trim(path, '/'), '/', -1)) AS name FROM path_request)
            SELECT request_id, BOOL_OR(k.name IS NOT NULL) AS any_exists FROM wanted w
            LEFT JOIN known k USING (drive_id, parent, name) GROUP BY request_id""",
            "path_request", "existing"),
        "path_exists": with_tables(
            """, known AS (SELECT drive_id, path FROM drive_item UNION SELECT drive_id, path FROM folder)
            SELECT r.request_id, r.drive_id, r.path,
              EXISTS (SELECT 1 FROM known k WHERE k.drive_id = r.drive_id AND k.path = ltrim(r.path, '/'))
              OR EXISTS (SELECT 1 FROM known k WHERE k.drive_id = r.drive_id
                AND k.path = rtrim(ltrim(r.path, '/'), '/') || '/') AS exists
            FROM path_request r""", "path_request", "drive_item", "folder"),
        "get_item": with_tables(
            """, r AS (SELECT request_id, drive_id, CASE WHEN ends_with(path, '.CSV') THEN lower(path)
                ELSE path END AS path FROM path_request)
            SELECT r.request_id, i.drive_id, i.path, i.file_size FROM r JOIN listing_sized i
            ON i.drive_id = r.drive_id AND trim(r.path, '/') = rtrim(i.path, '/')""",
            "path_request", "listing_sized"),
        "conflict_join": with_tables(
            """SELECT DISTINCT s.dest_drive_id AS drive_id, rtrim(s.dest_path, '/') AS key
            FROM transfer_spec s JOIN existing e ON e.drive_id = s.dest_drive_id
              AND e.bare = rtrim(s.dest_path, '/')""", "transfer_spec", "existing"),
        # usage
        "last_completed": with_tables(
            "SELECT drive_id, strftime(last_completed, '%Y-%m-%d %H:%M:%S') AS last_completed FROM cutoff",
            "cutoff"),
        "current_usage": with_tables(f"SELECT drive_id, path, bytes, {day} AS created FROM visible", "visible"),
        "folder_usage_total": with_tables(
            """SELECT CAST(SUM(bytes) AS BIGINT) AS bytes FROM visible
            WHERE drive_id = 7 AND starts_with(path, 'A/F/')""", "visible"),
        "subfolder_usage": with_tables(
            """SELECT 'A/F/' || split_part(path, '/', 3) || '/' AS path, CAST(SUM(bytes) AS BIGINT) AS bytes
            FROM visible WHERE drive_id = 7 AND starts_with(path, 'A/F/') GROUP BY 1""", "visible"),
        "usage_rollup": with_tables(
            """, f AS (SELECT drive_id, bytes, unnest(['/', split_part(path, '/', 1) || '/',
                split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/',
                regexp_extract(path, '^(.*/)[^/]*$', 1)]) AS folder FROM visible)
            SELECT drive_id, folder, CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(*) AS files
            FROM f GROUP BY 1, 2""", "visible"),
        "folded_rollup": with_tables(
            """, f AS (SELECT u.drive_id, bytes, unnest(['/', split_part(path, '/', 1) || '/',
                split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/',
                regexp_extract(path, '^(.*/)[^/]*$', 1)]) AS folder
              FROM memory_usage u JOIN cutoff c ON c.drive_id = u.drive_id AND c.last_completed = u.created
              WHERE path <> '///COMPLETED///')
            SELECT drive_id, folder, CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(*) AS files
            FROM f GROUP BY 1, 2""", "memory_usage", "cutoff"),
        "drive_total": with_tables(
            """SELECT drive_id, CAST(SUM(bytes) AS BIGINT) AS bytes FROM memory_usage
            WHERE path <> '///COMPLETED///' AND created = TIMESTAMP '2024-01-01 00:00:00'
            GROUP BY 1""", "memory_usage"),
        "biggest_files": with_tables(
            """SELECT drive_id, path, bytes FROM visible WHERE drive_id = 7
            ORDER BY bytes DESC, path LIMIT 50""", "visible"),
        "history_sample": _history(40),
        "history_range": with_tables(
            """SELECT drive_id, strftime(created, '%Y-%m-%d') AS day, bytes FROM drive_usage_history
            WHERE created BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-06-30'""",
            "drive_usage_history"),
        "snapshot_retention": with_tables(
            """SELECT u.drive_id, u.path, strftime(u.created, '%Y-%m-%d %H:%M:%S') AS created,
              COALESCE(u.created < c.cutoff, FALSE) AS expired
            FROM memory_usage u LEFT JOIN cutoff c ON c.drive_id = u.drive_id""",
            "memory_usage", "cutoff"),
        # audit
        "audit_statistics": with_tables(
            """SELECT action, COUNT(*) AS actions FROM action_audit
            WHERE status = 'S' AND created > TIMESTAMP '2024-01-05 00:00:00' GROUP BY action""",
            "action_audit"),
        "audit_between_status": with_tables(
            """SELECT status, action, COUNT(*) AS actions FROM action_audit
            WHERE status IN ('E', 'U') AND created > TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1, 2""",
            "action_audit"),
        "mask_audit": with_tables(
            """SELECT action_audit_id, username, CASE WHEN use_message THEN message END AS message
            FROM action_audit""", "action_audit"),
        "recent_actions": with_tables(
            """SELECT action_audit_id, action, path, CASE WHEN use_message THEN message END AS message
            FROM action_audit WHERE username = 'user7'
            ORDER BY created DESC, action_audit_id DESC LIMIT 50""", "action_audit"),
        "in_progress": with_tables(
            """SELECT action_audit_id, action, CASE WHEN use_message THEN message END AS message
            FROM action_audit WHERE username = 'user7' AND status = 'P' AND path = 'task'
            ORDER BY created DESC, action_audit_id DESC LIMIT 50""", "action_audit"),
        "audit_with_drive": with_tables(
            """SELECT a.action_audit_id, a.action, d.display_name, d.drive_type FROM action_audit a
            LEFT JOIN drive d ON d.drive_id = a.drive_id""", "action_audit", "drive"),
        "latest_pending": with_tables(
            """SELECT action_audit_id, username, action, path, drive_id, dest_path, dest_drive_id, status
            FROM action_audit
            QUALIFY ROW_NUMBER() OVER (PARTITION BY username, action, path, drive_id, dest_path,
              dest_drive_id, status
              ORDER BY created DESC, action_audit_id DESC) = 1""", "action_audit"),
        "latest_status": with_tables(
            """SELECT username, action_audit_id, status FROM action_audit
            QUALIFY ROW_NUMBER() OVER (PARTITION BY username ORDER BY created DESC,
              action_audit_id DESC) = 1""", "action_audit"),
        "transfer_progress": with_tables(
            """SELECT drive_id, path, done, total,
              CAST(FLOOR(CAST(done AS DOUBLE) / total * 100 + 0.5) AS INT) AS percent_complete
            FROM (SELECT drive_id, path,
                ROW_NUMBER() OVER (PARTITION BY drive_id ORDER BY path) AS done,
                COUNT(*) OVER (PARTITION BY drive_id) AS total FROM drive_item)""", "drive_item"),
        "audit_duration": with_tables(
            """SELECT action_audit_id, bytes_transferred AS duration_ms FROM action_audit""",
            "action_audit"),
        "grid_contains": _grid("message LIKE '%lick%'"),
        "grid_doesnotcontain": _grid("NOT message LIKE '%lick%'"),
        "grid_eq": _grid("action = 'copy'"),
        "grid_neq": _grid("message <> ''"),
        "grid_startswith": _grid("username LIKE 'user1%'"),
        "grid_endswith": _grid("path LIKE '%9.csv'"),
        "grid_isnull": _grid("message IS NULL"),
        "grid_isnotnull": _grid("message IS NOT NULL"),
        "grid_isempty": _grid("message = ''"),
        "grid_isnotempty": _grid("message <> ''"),
        "grid_created_day": _grid(
            "created >= TIMESTAMP '2024-01-10 00:00:00' AND created < TIMESTAMP '2024-01-11 00:00:00'"),
        "grid_drive_in": with_tables(
            """SELECT action_audit_id, username, action, path, message FROM action_audit
            WHERE drive_id IN (SELECT drive_id FROM drive WHERE CAST(drive_id AS VARCHAR) LIKE '%2%')""",
            "action_audit", "drive"),
        "grid_and": _grid("action = 'copy' AND username LIKE 'user1%' AND message LIKE '%k%'"),
        "grid_sort": with_tables(
            """SELECT action_audit_id, drive_id FROM action_audit
            ORDER BY drive_id DESC NULLS FIRST, action_audit_id LIMIT 500""", "action_audit"),
        "grid_page": with_tables(
            """SELECT action_audit_id, message FROM action_audit WHERE action = 'copy'
            ORDER BY message ASC NULLS LAST, action_audit_id LIMIT 50 OFFSET 100""", "action_audit"),
        "grid_total": with_tables(
            "SELECT COUNT(*) AS total FROM action_audit WHERE action = 'copy'", "action_audit"),
        # content
        "top_lines": f"""SELECT doc_id, CAST(u.i - 1 AS INT) AS line_no, lines[u.i] AS line
            FROM (SELECT doc_id, {_lines('text')} AS lines FROM documents) d,
            LATERAL (SELECT unnest(generate_series(1, LEAST(3, len(lines)))) AS i) u""",
        "first_line": f"""SELECT doc_id, COALESCE(({_lines('text')})[1], '') AS line FROM documents""",
        "preview": f"""SELECT doc_id, CAST(u.i - 1 AS INT) AS line_no, lines[u.i] AS line
            FROM (SELECT doc_id, {_lines('text')} AS lines FROM documents) d,
            LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i) u
            WHERE u.i <= 3 OR u.i > len(lines) - 2""",
        "chunk_manifest": with_tables(
            """, p AS (SELECT drive_id, path, file_size * 1000 AS size FROM drive_item)
            SELECT drive_id, path, CAST(u.i + 1 AS INT) AS part_number, u.i * 10485760 AS start_byte,
              LEAST(10485760, size - u.i * 10485760) AS part_bytes FROM p,
            LATERAL (SELECT unnest(generate_series(0, GREATEST(size - 1, 0) // 10485760)) AS i) u""",
            "drive_item"),
        "assemble_chunks": with_tables(
            """SELECT file_uid, 0 AS segment, CAST(SUM(octet_length(encode(data))) AS BIGINT) AS file_bytes,
              string_agg(data, '' ORDER BY chunk_index) AS content FROM upload_chunk
            GROUP BY file_uid HAVING COUNT(DISTINCT chunk_index) = MAX(total_chunks)""", "upload_chunk"),
        "upload_status": with_tables(
            """SELECT file_uid, COUNT(DISTINCT chunk_index) AS chunks_present,
              MAX(total_chunks) AS total_chunks,
              COUNT(DISTINCT chunk_index) = MAX(total_chunks) AS complete
            FROM upload_chunk GROUP BY file_uid""", "upload_chunk"),
        # plans
        "transfer_count": with_tables(
            """SELECT spec_id, COUNT(*) AS items FROM spec_item GROUP BY spec_id""", "spec_item"),
        "any_archived": with_tables(
            """SELECT s.spec_id, BOOL_OR(d.drive_type = 'S3' AND i.item_class = 'GLACIER') AS any_archived
            FROM transfer_spec s JOIN drive d ON d.drive_id = s.source_drive_id
            JOIN spec_item i ON i.spec_id = s.spec_id GROUP BY s.spec_id""",
            "transfer_spec", "drive", "spec_item"),
        "transfer_validate": with_tables(
            "SELECT spec_id, source_drive_id, dest_drive_id, reason FROM spec_checked", "spec_checked"),
        "transfer_plan": _transfer_plan("cancel"),
        "transfer_plan_overwrite": _transfer_plan("overwrite"),
        "transfer_plan_skip": _transfer_plan("skip"),
        "transfer_sequence": _transfer_sequence(),
        "items_by_path": with_tables(
            """SELECT spec_id, item_path AS source_path,
              ROW_NUMBER() OVER (PARTITION BY spec_id ORDER BY item_path) AS ordinal FROM spec_covered""",
            "spec_covered"),
        "rename_plan": with_tables(
            """, checked AS (SELECT s.*, CASE WHEN sd.drive_id IS NULL THEN 'no source drive'
                WHEN source_path IS NULL THEN 'no source path'
                WHEN dest_path IS NULL THEN 'no destination path'
                WHEN dd.drive_id IS NULL THEN 'no destination drive'
                WHEN NOT (source_r AND dest_c) THEN 'no permission'
                WHEN source_drive_id <> dest_drive_id THEN 'across drives'
                WHEN e.bare IS NOT NULL THEN 'destination exists' END AS why
              FROM spec_access s LEFT JOIN drive sd ON sd.drive_id = source_drive_id
              LEFT JOIN drive dd ON dd.drive_id = dest_drive_id
              LEFT JOIN existing e ON e.drive_id = dest_drive_id AND e.bare = rtrim(dest_path, '/')),
            turns AS (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND ROW_NUMBER() OVER (
                PARTITION BY why IS NULL, dest_drive_id, trim(dest_path, '/') ORDER BY spec_id) > 1
                THEN 'destination exists' ELSE why END AS why FROM checked),
            reached AS (SELECT s.spec_id, s.source_drive_id AS drive_id, i.item_path AS old_path, i.item_dest AS new_path,
                s.spec_id = MIN(s.spec_id) OVER (PARTITION BY s.source_drive_id, i.item_path) AS own
              FROM turns s JOIN spec_item i ON i.spec_id = s.spec_id WHERE s.why IS NULL)
            SELECT spec_id, drive_id, old_path, new_path, 'rename' AS decision, CAST(NULL AS VARCHAR) AS reason
            FROM reached WHERE own
            UNION ALL SELECT spec_id, source_drive_id, source_path, dest_path, 'reject', 'source not found' FROM turns
            WHERE why IS NULL AND spec_id NOT IN (SELECT spec_id FROM reached WHERE own)
            UNION ALL SELECT spec_id, source_drive_id, source_path, dest_path, 'reject', why FROM turns
            WHERE why IS NOT NULL""", "spec_access", "drive", "existing", "spec_item"),
        "delete_plan": _delete_plan(),
        "delete_order": with_tables(
            """SELECT drive_id, path, ROW_NUMBER() OVER (PARTITION BY drive_id ORDER BY
              ends_with(path, '/'), CASE WHEN NOT ends_with(path, '/') THEN path END,
              CASE WHEN ends_with(path, '/') THEN path END DESC) AS ordinal
            FROM listing WHERE starts_with(path, 'A/')""", "listing"),
        "storage_class_plan": with_tables(
            f"""SELECT q.request_id, q.drive_id, q.path, i.storage_class AS old_class, q.new_class,
              CASE WHEN why IS NULL THEN 'change' ELSE 'reject' END AS decision, why AS reason
            FROM (SELECT r.*, CASE WHEN NOT {held('A', 'r0.drive_id', 'r0.path', 'archive_rule')}
                THEN 'no permission' WHEN d.drive_type NOT IN ('Blob', 'GCS', 'S3') THEN 'not a cloud drive'
                WHEN c.storage_class IS NULL THEN 'unknown storage class'
                WHEN ends_with(r.path, '/') THEN 'not found' END AS why
              FROM change_request r JOIN change_request r0 ON r0.request_id = r.request_id
              JOIN drive d ON d.drive_id = r.drive_id
              LEFT JOIN storage_class c ON c.drive_type = d.drive_type AND c.storage_class = r.new_class) q
            LEFT JOIN drive_item i ON i.drive_id = q.drive_id AND i.path = q.path""",
            "change_request", "drive", "storage_class", "drive_item", "archive_rule"),
        "restore_plan": with_tables(
            f""", checked AS (SELECT r.*, d.drive_type,
                CASE WHEN NOT {held('U', 'r.drive_id', 'r.path', 'archive_rule')} THEN 'no permission'
                  WHEN d.drive_type NOT IN ('Blob', 'S3') THEN 'not a restorable drive' END AS why
              FROM change_request r JOIN drive d ON d.drive_id = r.drive_id)
            SELECT q.request_id, q.drive_id, i.path, 'restore' AS decision, CAST(NULL AS VARCHAR) AS reason
            FROM checked q JOIN drive_item i ON i.drive_id = q.drive_id AND i.path = q.path
            WHERE q.why IS NULL
            UNION ALL SELECT q.request_id, q.drive_id, i.path, 'restore', NULL
            FROM checked q JOIN item_parent i ON i.drive_id = q.drive_id AND i.parent || '/' = q.path
            WHERE q.why IS NULL AND i.storage_class = 'GLACIER' AND q.drive_type = 'S3'
            UNION ALL SELECT request_id, drive_id, path, 'reject', why FROM checked WHERE why IS NOT NULL""",
            "change_request", "drive", "item_parent", "archive_rule"),
        "temp_space": with_tables(
            f"""SELECT drive_id, CAST(SUM(file_size) AS BIGINT) AS bytes, COUNT(*) AS files
            FROM drive_item WHERE {TEMP} AND modified_date <= TIMESTAMP '1998-06-01 12:30:00'
              - INTERVAL 720 MINUTE GROUP BY 1""", "drive_item"),
        "expiry_plan": _expiry_plan(),
        # streams
        # append mode: windows that the watermark has closed; uploads are all rows, open ones too
        "stream_audit_statistics": with_tables(
            """, n AS (SELECT MAX(created) - INTERVAL 10 MINUTE AS mark FROM action_audit)
            SELECT strftime(date_trunc('hour', created), '%Y-%m-%d %H:%M:%S') AS started, action, status,
              COUNT(*) AS actions FROM action_audit, n
            WHERE date_trunc('hour', created) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2, 3""", "action_audit"),
        "stream_assemble_chunks": with_tables(
            """, a AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(CAST((file_uid % 48) * 3600 + chunk_index
                + CASE WHEN file_uid % 5 = 0 AND chunk_index >= 1 THEN 10800 ELSE 0 END AS BIGINT)) AS arrived
              FROM upload_chunk),
            s AS (SELECT file_uid, file_uid % 5 = 0 AND chunk_index >= 1 AS resumed, MIN(arrived) AS started,
                COUNT(*) AS chunks_present,
                MAX(total_chunks) AS total_chunks, MAX(chunk_index) AS last_index,
                CAST(SUM(octet_length(encode(data))) AS BIGINT) AS bytes FROM a GROUP BY 1, 2)
            SELECT file_uid, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, chunks_present, total_chunks,
              bytes, chunks_present = total_chunks AND last_index = total_chunks - 1 AS complete
            FROM s""", "upload_chunk"),
    }
    out["stored_usage"] = out["usage_rollup"]
    return out


TEMP = "(starts_with(split_part(path, '/', -1), 'o1') OR starts_with(split_part(path, '/', -1), 'O1'))"

TABLES["listing_sized"] = (("drive_item", "folder"), """
        SELECT drive_id, path, file_size FROM drive_item
        UNION ALL SELECT drive_id, path, 0 FROM folder""")


def _described() -> str:
    """Columns of the given tables by the types DuckDB reads, in Hive's names."""
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "FLOAT": "float"}
    named = " ".join(f"WHEN '{kind}' THEN '{hive}'" for kind, hive in kinds.items())
    return f"""SELECT table_name, ordinal, name,
          CASE WHEN starts_with(kind, 'TIMESTAMP') THEN 'timestamp_ntz'
            WHEN is_list THEN 'array<' || CASE kind {named} ELSE lower(kind) END || '>'
            ELSE CASE kind {named} ELSE lower(kind) END END AS type,
          CAST(NULL AS VARCHAR) AS error
        FROM (SELECT table_name, column_index - 1 AS ordinal, column_name AS name, ends_with(data_type, '[]') AS is_list,
            replace(data_type, '[]', '') AS kind FROM duckdb_columns() WHERE NOT internal)"""


def _described_csv(tables: tuple[str, ...]) -> str:
    """The narrowest type that fits the text of all values of each column."""
    values = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, name, v FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {t})"
        " ON COLUMNS(*) INTO NAME name VALUE v)" for t in tables
    )
    whole = "regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS {0}) IS NOT NULL"
    return f"""SELECT c.table_name, c.column_index - 1 AS ordinal, c.column_name AS name,
          CASE WHEN bool_and({whole.format('INTEGER')}) THEN 'int' WHEN bool_and({whole.format('BIGINT')}) THEN 'bigint'
            WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'double'
            WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean'
            WHEN bool_and(length(v) = 10 AND TRY_CAST(v AS DATE) IS NOT NULL) AND any_value(c.data_type) NOT LIKE 'TIMESTAMP%' THEN 'date'
            WHEN bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' ELSE 'string' END AS type,
          CAST(NULL AS VARCHAR) AS error
        FROM duckdb_columns() c LEFT JOIN ({values}) u ON u.table_name = c.table_name AND u.name = c.column_name
        WHERE NOT c.internal AND c.table_name IN ({', '.join(f"'{t}'" for t in tables)})
        GROUP BY ALL"""


def _delete_plan() -> str:
    may = held("D", "r.drive_id", "r.path")
    return with_tables(
        f"""
        , checked AS (SELECT r.*, {may} AS may FROM change_request r),
        reached AS (SELECT q.request_id, i.drive_id, i.path, ends_with(i.path, '/') AS is_folder
          FROM checked q JOIN listing i ON i.drive_id = q.drive_id AND i.path = q.path WHERE q.may
          UNION ALL SELECT q.request_id, i.drive_id, i.path, FALSE
          FROM checked q JOIN item_parent i ON i.drive_id = q.drive_id AND i.parent || '/' = q.path
          WHERE q.may),
        owned AS (SELECT *, request_id = MIN(request_id) OVER (PARTITION BY drive_id, path) AS own FROM reached),
        covered AS (SELECT * FROM owned WHERE own)
        SELECT request_id, drive_id, path,
          ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY is_folder,
            CASE WHEN NOT is_folder THEN path END, CASE WHEN is_folder THEN path END DESC) AS ordinal,
          'delete' AS decision, CAST(NULL AS VARCHAR) AS reason FROM covered
        UNION ALL SELECT request_id, drive_id, path, NULL, 'covered', NULL FROM owned WHERE NOT own
        UNION ALL SELECT request_id, drive_id, path, NULL, 'reject', 'no permission' FROM checked
        WHERE NOT may""",
        "change_request", "drive_security_rule", "listing", "item_parent",
    )


def _expiry_plan() -> str:
    hours = (24, 12, 6, 3, 1)
    limit = "TIMESTAMP '1998-06-01 12:30:00' - INTERVAL {0} HOUR"
    won = ", ".join(
        f"COALESCE(SUM(CASE WHEN modified_date <= {limit.format(h)} THEN file_size END), 0) AS w{h}"
        for h in hours
    )
    cases = " ".join(f"WHEN w{h} >= need THEN {h}" for h in hours)
    past = " OR ".join(
        f"(c.cutoff_hours = {h} AND i.modified_date <= {limit.format(h)})" for h in hours
    )
    return with_tables(
        f"""
        , t AS (SELECT * FROM drive_item WHERE {TEMP}),
        s AS (SELECT drive_id, SUM(file_size) AS total, {won} FROM t GROUP BY 1),
        n AS (SELECT drive_id, CAST(SUM(file_size) AS BIGINT) * (drive_id % 6) // 10 AS need
          FROM drive_item GROUP BY drive_id),
        c AS (SELECT s.drive_id, CASE WHEN 0 >= need OR total < need THEN NULL {cases} ELSE 1 END
            AS cutoff_hours, {' OR '.join(f'w{h} >= need' for h in hours)} AS sufficient
          FROM s JOIN n ON n.drive_id = s.drive_id)
        SELECT i.drive_id, i.path, i.file_size, c.cutoff_hours, c.sufficient
        FROM t i JOIN c ON c.drive_id = i.drive_id WHERE {past}""",
        "drive_item",
    )
