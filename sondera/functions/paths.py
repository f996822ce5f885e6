"""Path and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def suffix(path: Column) -> Column:
    """From the last dot of the name on; none if the name only begins with one."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def frame_file(index: Column, extension: str = "npy") -> Column:
    return F.format_string(f"frame_%06d.{extension}", index)


def flat_name(path: Column) -> Column:
    """part/video/frame.jpg as part-video-frame.jpg; null unless there are three levels and no hyphen in the first two."""
    level = F.split(path, "/")
    good = (F.size(level) == 3) & ~level[0].contains("-") & ~level[1].contains("-")
    return F.when(good, F.concat_ws("-", level))


def inside(path: Column, directory: Column) -> Column:
    """Whether a path stays under a directory, with no step up."""
    return path.startswith(F.concat(F.rtrim(directory, F.lit("/")), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def family_key(part: Column, label: Column, original: Column, file: Column) -> Column:
    """part/stem: of the original for a fake (label 1), of the file itself otherwise."""
    return F.concat_ws("/", part, F.when(label == 1, stem(original)).otherwise(stem(file)))
