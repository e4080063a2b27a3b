"""Column functions for paths, file names and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_stem(name) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def basename(path) -> Column:
    return F.element_at(F.split(F.translate(_c(path), "\\", "/"), "/"), -1)


def stem(path) -> Column:
    """The base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path) -> Column:
    """The last suffix in lower case with its dot, or an empty string."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def strip_upload_prefix(name) -> Column:
    """What follows the first hyphen, or the name if nothing does."""
    rest = F.regexp_replace(_c(name), r"^[^-]*-", "")
    return F.when(rest == "", _c(name)).otherwise(rest)


def strip_chunk_suffix(stem_) -> Column:
    """Without a chunk number of five digits at the end."""
    return F.regexp_replace(_c(stem_), r"_[0-9]{5}$", "")


def subfolder_after(path, prefix: str) -> Column:
    """The first segment after a prefix, or __root__ where the file stands in the prefix itself."""
    rest = F.regexp_replace(_c(path), "^" + prefix, "")
    return F.when(F.instr(rest, "/") > 0, F.coalesce(F.nullif(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("")), F.lit("__root__"))).otherwise(F.lit("__root__"))


def label_path(path) -> Column:
    """Audio path to label path: the last `wav` before a slash becomes `lbl`, the suffix `.h5`; other paths raise."""
    pattern = r"(?i)^(.*)wav(/.*\.)[a-z0-9]+$"
    bad = F.raise_error(F.concat(F.lit("no label path for "), _c(path)))
    return F.when(F.regexp_like(_c(path), F.lit(pattern)), F.regexp_replace(_c(path), pattern, "$1lbl$2h5")).otherwise(bad.cast("string"))


def label_from_name(name, pattern: str | None = None, skip: int = 2) -> Column:
    """Group 1 of a pattern at the start of the stem, or its underscore parts from `skip` on, joined."""
    s = stem(name)
    if pattern:
        return F.nullif(F.regexp_extract(s, f"^(?:{pattern})", 1), F.lit(""))
    parts = F.split(s, "_")
    return F.when(F.size(parts) > skip, F.array_join(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), "_"))


def class_key(path) -> Column:
    """The parent folder where it is noise or begins with K, else what precedes the first hyphen of the base name."""
    parent = F.regexp_extract(_c(path), r"([^/]+)/[^/]*$", 1)
    return F.when((parent == "noise") | parent.startswith("K"), parent).otherwise(F.split_part(basename(path), F.lit("-"), F.lit(1)))


def relative_to(path, root: str) -> Column:
    """The path below a root; other paths stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(_c(path).startswith(base), F.substring(_c(path), F.lit(len(base) + 1), F.length(_c(path)))).otherwise(_c(path))


def join_url(base: str, href) -> Column:
    """A link as an absolute URL: whole links stay, those from the root or from the scheme on take the base's, others its folder.

    `.` and `..` steps are resolved, `..` never above the root.
    """
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)([^?#]*)", base)
    scheme, site, folder = m[1], f"{m[1]}//{m[2]}", m[3].rpartition("/")[0] + "/"
    h = _c(href)
    joined = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.lit(scheme), h)).when(h.startswith("/"), F.concat(F.lit(site), h)).otherwise(F.concat(F.lit(site + folder), h))
    rest = F.regexp_extract(joined, r"[?#].*$", 0)
    head = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", 1)
    steps = F.split(F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", 2), "/")
    last = F.element_at(steps, -1)
    done = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
    )
    path = F.concat(F.lit("/"), F.array_join(done, "/"), F.when(last.isin(".", "..") & (F.size(done) > 0), "/").otherwise(""))
    return F.when(head == "", joined).otherwise(F.concat(head, F.when(F.size(steps) > 1, path).otherwise(""), rest))


def under_base(url, base: str) -> Column:
    """Whether a URL has a base URL's scheme and host, and a path below its path."""
    m = re.match(r"([a-z]+)://([^/]+)(/[^?#]*)?", base)
    u = _c(url)
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    return F.coalesce((F.try_parse_url(u, F.lit("PROTOCOL")) == m[1]) & (F.try_parse_url(u, F.lit("HOST")) == m[2]) & path.startswith(m[3] or "/"), F.lit(False))


def year_month(key) -> tuple[Column, Column]:
    """Year and two-digit month from the first two all-digit path segments of a key."""
    digits = F.filter(F.split(_c(key), "/"), lambda x: F.regexp_like(x, F.lit("^[0-9]+$")))
    return F.get(digits, 0), F.lpad(F.get(digits, 1), 2, "0")
