"""Path and locator columns. A null gives a null unless a docstring says otherwise; equal inputs give equal outputs, so ties and repeats need no rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(path) -> Column:
    """The non-empty segments of a path."""
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def basename(path) -> Column:
    """What follows the last slash."""
    return F.substring_index(_c(path), "/", -1)


def stem(name) -> Column:
    """A name without its extension; the dot must not come first."""
    return F.regexp_replace(_c(name), r"^(.+)\.[^.]*$", "$1")


def extension(name) -> Column:
    """From the last dot on, if that is not the first character; else empty."""
    return F.regexp_extract(_c(name), r"^.+(\.[^.]*)$", 1)


def normal_extension(ext) -> Column:
    """Trimmed, lower case, with a dot; empty or null gives empty."""
    value = F.lower(F.trim(F.coalesce(_c(ext), F.lit(""))))
    return F.when(F.coalesce(_c(ext), F.lit("")) == "", "").when(value.startswith("."), value).otherwise(F.concat(F.lit("."), value))


def locator(value) -> Column:
    """A place as it is compared: drive paths with slashes, in lower case; others without a last slash; null or blank gives empty."""
    text = F.trim(F.coalesce(_c(value), F.lit("")))
    drive = text.contains(":") & (text.contains("\\") | text.contains("/"))
    plain = F.rtrim(text, F.lit("/"))
    return F.when(text == "", "").when(drive, F.lower(F.rtrim(F.replace(text, F.lit("\\"), F.lit("/")), F.lit("/")))).otherwise(F.when(plain == "", "/").otherwise(plain))


def remote_path(value) -> Column:
    """Starts with a slash, without '.' and empty segments; null if a segment is '..' (the path is refused), '/' if blank or null."""
    parts = F.filter(F.split(F.trim(F.coalesce(_c(value), F.lit(""))), "/"), lambda x: (x != "") & (x != "."))
    return F.when(~F.array_contains(parts, ".."), F.concat(F.lit("/"), F.array_join(parts, "/")))


def rebased(local, mount, remote) -> Column:
    """The path under `remote` of a local path under `mount`, compared without case; null if it isn't below."""
    clean = lambda x: F.rtrim(F.replace(F.trim(_c(x)), F.lit("/"), F.lit("\\")), F.lit("\\"))
    at, root = clean(local), clean(mount)
    rest = F.replace(F.ltrim(F.substr(at, F.length(root) + 1), F.lit("\\")), F.lit("\\"), F.lit("/"))
    below = (root != "") & F.startswith(F.lower(at), F.concat(F.lower(root), F.lit("\\"))) & (rest != "")
    return F.when(below, remote_path(F.concat(F.rtrim(F.coalesce(_c(remote), F.lit("/")), F.lit("/")), F.lit("/"), rest)))


def is_within(path, ancestor) -> Column:
    """Whether a path is the ancestor or below it, by whole segments; '/' is above all."""
    base = F.rtrim(_c(ancestor), F.lit("/"))
    return (_c(path) == base) | F.startswith(_c(path), F.concat(base, F.lit("/"))) | (base == "")


def common_ancestor(a, b) -> Column:
    """The longest path of whole segments that both start with; '/' if none."""
    one, two = segments(a), segments(b)
    n = F.least(F.size(one), F.size(two))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.slice(one, F.lit(1), i) == F.slice(two, F.lit(1), i)))
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.concat(F.lit("/"), F.array_join(F.slice(one, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/")))


def parent(path) -> Column:
    """The path without its last segment; '/' at the top."""
    parts = segments(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
