"""Scalar expressions over names, paths and source text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script extensions of test files, and names and name endings of infrastructure files.
TEST_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
INFRA_NAMES = ("program.cs", "startup.cs")
INFRA_ENDINGS = ("serviceextensions", "servicecollectionextensions", "registration", "testbase", "testsbase", "basetest", "basetests", "basefixture")

ASCII_TRIM = " \t\r\n\u000b\u000c"


def tokens(query: Column) -> Column:
    """Lower-case white-space tokens without empty ones."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != "")


def matched(words: Column, text: Column) -> Column:
    """How many of the tokens stand in the lower-cased text."""
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))


def name_tokens(name: Column) -> Column:
    """Distinct ASCII words of a name in lower case: cut at all but letters and digits and before a capital that follows a small letter
    or digit, or that a small letter follows."""
    apart = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.array_distinct(F.transform(F.filter(F.split(apart, "[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.lower(w)))


def bounded_distance(a: Column, b: Column, bound: int = 2) -> Column:
    """Edit distance, or bound + 1 beyond it."""
    d = F.levenshtein(a, b, bound)
    return F.when(d < 0, F.lit(bound + 1)).otherwise(d)


def project(path: Column) -> Column:
    """The first segment of a path, empty for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_name(identity: Column) -> Column:
    return F.regexp_extract(identity, r"[^.+]*$", 0)


def unnumbered(name: Column) -> Column:
    return F.regexp_replace(name, r"-[0-9]+$", "")


def clipped(line: Column, width: int = 120) -> Column:
    return F.left(F.btrim(line, F.lit(ASCII_TRIM)), F.lit(width))


def is_test_path(path: Column) -> Column:
    """A script file named as a test or spec, or below a directory ``__tests__``."""
    script = "(" + "|".join(TEST_EXTENSIONS) + r")\z"
    return path.rlike(r"\.(spec|test)\." + script) | (path.rlike(r"\." + script) & path.rlike("(^|/)__tests__/"))


def is_infra_path(path: Column) -> Column:
    """A file that others refer to for its job: entry points, registrations, bases of tests, composition roots."""
    whole = F.lower(path)
    base = basename(whole)
    ends = whole.rlike("(" + "|".join(INFRA_ENDINGS) + r")\.cs\z")
    return base.isin(*INFRA_NAMES) | ends | whole.rlike("(^|/)dependencyresolution/") | base.rlike(r"^((?!compositionroot).)*compositionroot[a-z0-9]*\.cs\z")


def is_file_shaped(seed: Column) -> Column:
    return F.contains(seed, F.lit("/")) | seed.rlike(r"\.[A-Za-z0-9]+$")


def purpose(source: Column) -> Column:
    """The first line with ink of the first 15, without its comment mark if text follows it, clipped to 100 characters; null if none."""
    lines = F.transform(F.slice(F.split(source, "\n"), 1, 15), lambda x: F.regexp_replace(x, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))
    line = F.get(F.filter(lines, lambda x: x != ""), 0)
    said = F.regexp_replace(F.regexp_extract(line, r"(?s)^(///?|\*|#)(.*)$", 2), r"(?U)^\s+", "")
    out = F.when(said != "", said).otherwise(line)
    return F.when(F.length(out) > 100, F.concat(F.left(out, F.lit(97)), F.lit("..."))).otherwise(out)


def whole_token(line: Column, needle: Column) -> Column:
    """The needle stands in the line between non-word bytes."""
    return F.regexp_like(line, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), needle, F.lit(r"\E(?![A-Za-z0-9_])")))


def stem(path: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(basename(path), r"\.[^.]*$", ""), "-_.", ""))


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` from the directory ``base``, normalised; null if it climbs above the root."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walked = F.aggregate(parts, start, lambda acc, p: F.when(acc.isNull(), F.lit(None)).when((p == "..") & (F.size(acc) == 0), F.lit(None)).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest first, down to the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def percent_tenths(part: Column, whole: Column) -> Column:
    """A percentage in whole tenths, half up; 0 without a whole."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor((part * 2000 + whole) / (whole * 2))).cast("long")
