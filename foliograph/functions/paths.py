"""Paths: canonical (NFD) form, globs as regular expressions, links to targets, ancestor folders."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]+:"


def nfd_text(s: str | None) -> str | None:
    return s if s is None or s.isascii() else unicodedata.normalize("NFD", s)


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition, under which paths are matched."""
    return s.map(nfd_text, na_action="ignore")


def glob_to_regex(glob: str) -> str:
    """``*`` stays within a folder, ``**`` crosses folders, ``?`` is one character; a trailing ``/`` means all below."""
    g = nfd_text(glob)
    if g.startswith("./"):
        g = g[2:]
    if g.endswith("/"):
        g += "**"
    if ".." in g.split("/"):
        raise ValueError(f"a glob cannot leave the workspace: {glob}")
    out, parts = [], g.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", part)))
        if not last:
            out.append("/")
    return "^" + "".join(out) + r"\z"


def _any(column: Column, regexes: list[str]) -> Column:
    return column.rlike("(?s)" + "|".join(f"(?:{r})" for r in regexes))


def glob_filter(path_nfd: Column, globs: list[str]) -> Column:
    """Kept when any glob matches, less those that a glob starting with ``!`` matches; with only such globs, all else."""
    yes = [glob_to_regex(g) for g in globs if not g.startswith("!")]
    no = [glob_to_regex(g[1:]) for g in globs if g.startswith("!")]
    keep = _any(path_nfd, yes) if yes else F.lit(True)
    return keep & ~_any(path_nfd, no) if no else keep


def covered(path_nfd: Column, globs: list[str]) -> Column:
    """Whether a glob matches a path or a folder that holds it."""
    return _any(path_nfd, [glob_to_regex(g).removesuffix(r"\z") + r"(?:/.*)?\z" for g in globs])


def glob_matches(path: str, globs: list[str]) -> bool:
    """``glob_filter`` for one path on the driver."""
    p = nfd_text(path)
    test = lambda g: re.compile("(?s)" + glob_to_regex(g).replace(r"\z", r"\Z")).search(p) is not None
    yes = [g for g in globs if not g.startswith("!")]
    return (not yes or any(map(test, yes))) and not any(test(g[1:]) for g in globs if g.startswith("!"))


def ancestors(path: Column) -> Column:
    """All folders that hold a path, without the root: ``a/b/c.md`` gives ``a``, ``a/b``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:^|/)[^/]*\z", "")


def classify(raw: Column, is_url: bool = True) -> Column:
    """``url`` for a scheme or a leading ``//``, ``anchor`` if nothing is left without fragment (and query), else ``path``."""
    rest = F.regexp_replace(raw, r"(?s)[#?].*" if is_url else r"(?s)#.*", "")
    return F.when(raw.rlike(URL_SCHEME) | raw.startswith("//"), "url").when(rest == "", "anchor").otherwise("path")


def resolve(raw: Column, base: Column, bundle: Column | None = None) -> Column:
    """The target of an undecoded path link from a page in folder ``base``: fragments and queries cut, ``.`` and ``..``
    folded; null above the root, empty for the root. Native; ``resolve_text`` is the full form with decoding."""
    path = F.regexp_replace(raw, r"(?s)[#?].*", "")
    root = bundle if bundle is not None else F.lit("")
    joined = F.when(path.startswith("/"), F.concat_ws("/", root, path)).otherwise(F.concat_ws("/", base, path))
    steps = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")

    def step(held: Column, x: Column) -> Column:
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        above = F.lit(None).cast("array<string>")
        return F.when(x != "..", F.concat(held, F.array(x))).when(F.size(held) > 0, up).otherwise(above)

    return F.aggregate(steps, start, step, lambda held: F.array_join(held, "/"))


def percent_decode(s: str) -> str:
    """Escapes become UTF-8; malformed ones stay as written."""
    if "%" not in s:
        return s
    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: unquote_to_bytes(m[0]).decode("utf-8", "replace"), s)


def resolve_text(raw: str, page: str, bundle: str, from_bundle: bool, is_url: bool) -> tuple[str, str | None]:
    """(type, target) of a link as written on ``page``."""
    if re.match(URL_SCHEME, raw) or raw.startswith("//"):
        return "url", None
    path = re.split(r"[#?]" if is_url else "#", raw, maxsplit=1)[0]
    if not path:
        return "anchor", None
    if is_url:
        path = percent_decode(path)
    folder = page.rpartition("/")[0]
    base = bundle if path.startswith("/") or from_bundle else folder
    steps: list[str] = []
    for step in [*base.split("/"), *path.split("/")]:
        if step in ("", "."):
            continue
        if step == "..":
            if not steps:
                return "path", None
            steps.pop()
        else:
            steps.append(step)
    return "path", "/".join(steps)


def bundle_of(path: str, bundles: list[str]) -> str:
    """The deepest configured bundle that holds a path, else the root."""
    return max((b for b in bundles if path.startswith(b + "/")), key=len, default="")
