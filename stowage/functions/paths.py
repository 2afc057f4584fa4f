"""Path expressions. Paths use ``/``; a trailing slash marks a folder.

The functions mention their argument once or a few times, so that nesting
them does not multiply the expression under a derived path column too much.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLASH = "/"


def add_first_slash(path: Column) -> Column:
    return F.concat(F.lit(SLASH), remove_first_slash(path))


def add_last_slash(path: Column) -> Column:
    return F.concat(remove_last_slash(path), F.lit(SLASH))


def add_both_slashes(path: Column) -> Column:
    return add_first_slash(add_last_slash(path))


def _leading(path: Column) -> Column:
    """Length of the slash in front, 1 or 0. Substrings cost a scan far less than patterns do."""
    return F.when(path.startswith(SLASH), 1).otherwise(0)


def remove_first_slash(path: Column) -> Column:
    return F.substr(path, _leading(path) + 1)


def remove_last_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"/\z", "")


def remove_both_slashes(path: Column) -> Column:
    first = _leading(path)
    last = F.when(path.endswith(SLASH) & (F.length(path) > 1), 1).otherwise(0)
    return F.substr(path, first + 1, F.length(path) - first - last)


def is_directory(path: Column) -> Column:
    return path.endswith(SLASH)


def file_name(path: Column) -> Column:
    """Last segment; a folder's trailing slash does not count."""
    return F.substring_index(remove_last_slash(path), SLASH, -1)


def extension(name: Column) -> Column:
    """Text after the last dot of a file name, empty when there is none."""
    return F.regexp_extract(name, r"(?s)\.([^.]*)\z", 1)


def _slashed(text: Column, stand_in: str) -> Column:
    """The text, or `stand_in` when it has no slash (or is null)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[^/]*\z", stand_in)


def parent_folder(path: Column) -> Column:
    """Everything before the last slash; ``/`` when there is no slash at all."""
    return F.regexp_extract(_slashed(path, "//"), r"(?s)^(.*)/", 1)


def parent_folder_path(path: Column) -> Column:
    """Parent with a trailing slash and no leading one; ``/`` at root level."""
    inner = remove_both_slashes(path)
    name = F.substring_index(inner, SLASH, -1)
    parent = F.substr(inner, F.lit(1), F.length(inner) - F.length(name))
    return F.coalesce(F.nullif(parent, F.lit("")), F.lit(SLASH))


def to_unix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def to_windows(path: Column) -> Column:
    return F.translate(path, "/", "\\")


def has_drive_letter(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^[A-Za-z]:[/\\]"), F.lit(False))


def remove_drive_letter(path: Column) -> Column:
    return F.when(has_drive_letter(path), F.substring(path, 4, 2147483647)).otherwise(path)


def is_root(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).isin("", SLASH)


def matches_path(path: Column, other: Column) -> Column:
    """Equality that ignores one outer slash on each side."""
    return remove_both_slashes(path) == remove_both_slashes(other)


def is_inside(path: Column, start: Column) -> Column:
    inner = remove_first_slash(path)
    return (inner != start) & inner.startswith(remove_first_slash(start))


def same_source_dest(
    source_drive: Column, source: Column, dest_drive: Column, dest: Column
) -> Column:
    same_path = (source == dest) | (source == F.concat(dest, F.lit(SLASH)))
    return (source_drive == dest_drive) & same_path


def relative_path(base: Column, path: Column) -> Column:
    """`path` below `base`, without the separator that follows the base."""
    tail = F.when(path.startswith(base), F.substr(path, F.length(base) + 1)).otherwise(path)
    leads = tail.startswith("/") | tail.startswith("\\")
    return F.when(leads, F.substring(tail, 2, 2147483647)).otherwise(tail)


def rebase_path(path: Column, source: Column, dest: Column) -> Column:
    """Swap the leading `source` for `dest`; other paths stay as they are."""
    moved = F.concat(dest, F.substr(path, F.length(source) + 1))
    return F.when(path.startswith(source), moved).otherwise(path)


def base_name(path: Column) -> Column:
    """File name up to its last dot."""
    return F.regexp_replace(file_name(path), r"(?s)\.[^.]*\z", "")


def avsc_location(path: Column) -> Column:
    """Where the schema file of an Avro data file lives: one folder above the data."""
    above = parent_folder(remove_last_slash(parent_folder(remove_last_slash(path))))
    return F.concat(add_last_slash(above), base_name(path), F.lit(".avsc"))


def folder_key(path: Column) -> Column:
    """Canonical folder form: no leading slash, one trailing slash, root is ``/``."""
    return F.concat(remove_both_slashes(F.coalesce(path, F.lit(""))), F.lit(SLASH))


def folder_prefix(path: Column) -> Column:
    """What the keys below a folder start with: its folder key, or nothing for the root."""
    return F.regexp_replace(folder_key(path), r"^/\z", "")


def move_below(path: Column, source: Column, dest: Column) -> Column:
    """Key of an item under folder `source` once the folder is `dest`."""
    rest = F.substr(remove_first_slash(path), F.length(folder_prefix(source)) + 1)
    return F.concat(folder_prefix(dest), rest)


def ancestors(path: Column, with_root: bool = False) -> Column:
    """All folders above `path`, nearest last, as an array of folder keys."""

    def folders_of(segments: Column) -> Column:
        count = F.size(segments)
        # sequence(1, 0) would count down, hence the guard
        depths = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            depths,
            lambda depth: F.concat(
                F.array_join(F.slice(segments, F.lit(1), depth), SLASH), F.lit(SLASH)
            ),
        )

    # one-element transform: binds the segments to a name, so they are split once
    segments = F.split(remove_both_slashes(path), SLASH)
    folders = F.get(F.transform(F.array(segments), folders_of), F.lit(0))
    return F.concat(F.array(F.lit(SLASH)), folders) if with_root else folders


def beginnings(text: Column) -> Column:
    """Every beginning of a text that ends with a slash, as it is spelled, and the empty one."""

    def joined(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.when(n == 1, F.lit("")).otherwise(
                F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), SLASH), F.lit(SLASH))
            ),
        )

    # one-element transform: the text is split once
    return F.get(F.transform(F.array(F.split(text, SLASH, -1)), joined), F.lit(0))


def self_and_ancestors_of_folder(folder: Column) -> Column:
    """The folder itself, every folder above it, and the root."""
    return F.array_distinct(F.concat(ancestors(folder, with_root=True), F.array(folder_key(folder))))
