"""Path and text scalars as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a corrective commit subject.
CORRECTIVE = (
    "fix", "bug", "defect", "hotfix", "regression", "crash", "error", "fail", "patch", "resolve", "correct", "workaround",
    "oops", "typo", "npe", "nullpointer", "segfault", "leak", "broken", "issue #", "fixes #", "closes #",
)
#: Languages by file extension.
LANGUAGES = {"typescript": ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs"), "rust": ("rs",), "python": ("py", "pyi"), "go": ("go",), "java": ("java",)}
TEST_NAMES = r"\.test\.|\.spec\.|_test\.(go|rs|py)$|^test_"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, also where ``use`` holds it in another function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """The directory part, ``.`` if there is none."""
    found = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(F.contains(path, F.lit("/")), found).otherwise(F.lit("."))


def package_label(path: Column) -> Column:
    return F.when(path == ".", F.lit("(root)")).otherwise(basename(path))


def normalize_path(path: Column) -> Column:
    """``.`` and empty segments go, ``..`` takes back its parent; nothing left is ``.``."""
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def normalize_rel(path: Column) -> Column:
    """Trim, strip every leading ``./``, then turn backslashes."""
    return F.replace(F.regexp_replace(F.trim(path), r"^(\./)+", ""), F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """The lower-cased extension; null for dotfiles and names without a dot."""

    def of(name: Column) -> Column:
        long = F.regexp_extract(name, r"^[^.].*\.([^.]+)$|^[^.]+\.([^.]+)$", 1)
        return once(F.regexp_extract(name, r"^[^.]+\.([^.]+)$", 1), lambda alone: F.lower(F.when(alone != "", alone).otherwise(long)))

    # Most names need no rule: a dot inside and no line ends.
    name, last = F.substring_index(path, "/", -1), F.substring_index(path, ".", -1)
    plain = F.contains(name, F.lit(".")) & ~F.startswith(name, F.lit(".")) & ~F.endswith(name, F.lit(".")) & ~F.regexp_like(name, F.lit("[\n\r\\x{85}\\x{2028}\\x{2029}]"))
    return F.when(plain, F.lower(last)).otherwise(once(once(basename(path), of), lambda found: F.nullif(found, F.lit(""))))


def language_of(path: Column) -> Column:
    # Not a map: Spark would build it anew for every row.
    def known(ext: Column) -> Column:
        found = F.when(ext.isNull(), None)
        for language, exts in LANGUAGES.items():
            found = found.when(ext.isin(*exts), language)
        return found.otherwise("other")

    return once(extension(path), known)


def is_test_path(path: Column) -> Column:
    return F.regexp_like(F.lower(basename(path)), F.lit(TEST_NAMES)) | F.contains(path, F.lit("/__tests__/")) | F.contains(path, F.lit("/tests/"))


def is_corrective(subject: Column) -> Column:
    lowered = F.lower(subject)
    return F.exists(F.array(*map(F.lit, CORRECTIVE)), lambda k: F.contains(lowered, k))


def ancestors(path: Column) -> Column:
    """All proper directory prefixes, longest first, without the root."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def immediate_child(path: Column, scope: Column) -> Column:
    """The first segment below ``scope`` with the scope before it; null outside, and for files right below ``.``."""
    below = F.substr(path, F.length(scope) + 2)
    inside = F.startswith(path, F.concat(scope, F.lit("/")))
    top = F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1)))
    return F.when(scope == ".", top).when(inside, F.concat(scope, F.lit("/"), F.split_part(below, F.lit("/"), F.lit(1))))


def matches_target(path: Column, pattern: Column) -> Column:
    return (pattern == ".") | (path == pattern) | F.startswith(path, F.concat(pattern, F.lit("/")))


def affected_file(entry: Column) -> Column:
    """The path of ``path:12 - text``, ``path - text`` or ``path``; null for blanks."""
    head = F.regexp_replace(F.trim(entry), r"(?s)\s+[—–-]\s.*$", "")
    path = F.regexp_replace(F.trim(head), r":\d+(:\d+)?$", "")
    return F.nullif(path, F.lit(""))


def severity_rank(severity: Column) -> Column:
    lowered = F.lower(severity)
    return F.when(lowered == "error", 3).when(lowered == "warning", 2).when(lowered.isin("info", "hint"), 1).otherwise(2)


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves up, as BIGINT."""
    return F.floor(value + F.lit(0.5)).cast("long")


def palette_index(name: Column, colours: int = 15) -> Column:
    """Index of a colour by a 31-multiplier hash with 32-bit wrap-around."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.shiftright(F.shiftleft(h * 31 + c, 32), 32))
    return F.abs(wrapped) % colours
