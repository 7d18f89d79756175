"""Kinds of files and what to do with them. Nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension, normal_extension

# File extensions by kind.
KINDS = {
    "video": [".mkv", ".mp4", ".avi", ".ts", ".m2ts", ".wmv", ".flv", ".rmvb", ".mov"],
    "subtitle": [".ass", ".srt", ".ssa", ".vtt"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"],
    "nfo": [".nfo"],
    "font": [".ttf", ".ttc", ".otf"],
    "archive": [".zip", ".rar", ".7z", ".exe"],
    "audio": [".mp3", ".flac", ".mka", ".wav", ".aac", ".ogg", ".wma"],
    "text": [".txt", ".log", ".cue", ".md", ".ini", ".cfg", ".conf"],
}
#: Names that scans leave out.
SYSTEM_FILES = ["thumbs.db", "desktop.ini", ".ds_store"]


def _of(ext: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, some in KINDS.items():
        found = F.when(ext.isin(*some), kind).otherwise(found)
    return found


def kind(name, ext=None, hint=None) -> Column:
    """video, subtitle, nfo, image, font, archive, audio, text or other: by extension, else by name, else by a hint."""
    text = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) if x is not None else F.lit("")
    given = normal_extension(text(ext))
    own = F.when(given != "", given).otherwise(F.lower(extension(text(name))))
    weak = F.lower(F.trim(text(hint)))
    return F.coalesce(_of(own), F.when(weak.isin(*KINDS), weak), F.lit("other"))


def action(kind: Column) -> Column:
    """generate_strm for videos, attach_only for subtitles, ignore for the rest."""
    return F.when(kind == "video", "generate_strm").when(kind == "subtitle", "attach_only").otherwise("ignore")


def stable_id(source, path) -> Column:
    """MD5 of 'source:path', so the same path has the same id at every scan."""
    return F.md5(F.concat_ws(":", source, path))


def is_system(name) -> Column:
    return F.lower(name).isin(*SYSTEM_FILES)
