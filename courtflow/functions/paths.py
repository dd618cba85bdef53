"""Column expressions that read games, stems and frame numbers out of paths."""

from pyspark.sql import functions as F

from .geometry import col


def unix_path(path):
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def file_name(path):
    return F.regexp_extract(unix_path(path), r"([^/]+)$", 1)


def file_stem(path):
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def game_of(path):
    """Name of the parent folder."""
    return F.regexp_extract(unix_path(path), r"([^/]+)/[^/]+$", 1)


def frame_stem(path):
    """Stem without the suffix that marks resized copies."""
    return F.replace(file_stem(path), F.lit("_640x360"), F.lit(""))


def _number(text):
    return F.coalesce(F.when(text != "", text.try_cast("bigint")), F.lit(-1).cast("bigint"))


def last_digits(stem):
    return _number(F.regexp_extract(col(stem), r"(\d+)\D*$", 1))


def last_token(path):
    """The part of the stem after its last underscore, as a number."""
    return _number(F.regexp_extract(file_stem(path), r"(?:^|_)([+-]?\d+)$", 1))


def frame_tag(name):
    """Digits after the word ``frame_``."""
    return _number(F.regexp_extract(col(name), r"frame_(\d+)", 1))


def remap_root(path, root):
    """Point relative ``data/...`` paths at another root folder."""
    p = unix_path(path)
    return F.when(
        p.startswith("data/"), F.concat(F.lit(root.rstrip("/") + "/"), F.substring(p, 6, 1 << 20))
    ).otherwise(p)
