"""Text to facts at the source boundary: small scanners for a documented subset of each language, Arrow-batched over files.

Full parsing is not covered: definitions, imports and re-exports are found by line patterns, template reads by ``{{ }}`` and bound
attributes, conditional compilation by blanking what is inactive. Facts of full parsers can be read in the same schemas.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFINITION = {
    "cs": re.compile(r"^\s*(?:(?:public|internal|private|protected|static|sealed|abstract|partial|readonly|file)\s+)*(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"),
    "ts": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|function|enum|type|const)\s+([A-Za-z_$][\w$]*)"),
    "rs": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(struct|enum|trait|fn|mod|type|union)\s+([A-Za-z_]\w*)"),
}
IMPORT = {
    "cs": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;"),
    "ts": re.compile(r"^\s*(?:import|export)\b[^'\"]*?(?:from\s*)?()['\"]([^'\"]+)['\"]"),
    "rs": re.compile(r"^\s*(?:pub\s+)?use\s+()([\w:{}, *]+);"),
}
LANGUAGE = {"cs": "cs", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "rs": "rs"}


def evaluate(condition: str, symbols: frozenset[str] = frozenset()) -> bool:
    """A conditional-compilation expression: !, &&, ||, ==, !=, parentheses, true, false and symbols (undefined: false). A malformed
    one (empty, a character of no token, an open parenthesis, tokens left over) is false."""
    tokens = re.findall(r"&&|\|\||==|!=|!|\(|\)|[^\W\d]\w*|[^ \t]", condition.strip(" \t\r"))
    try:
        value, rest = _either(tokens, symbols)
    except ValueError:
        return False
    return value and not rest


def _unary(tokens: list[str], symbols: frozenset[str]) -> tuple[bool, list[str]]:
    match tokens:
        case ["!", *rest]:
            value, rest = _unary(rest, symbols)
            return not value, rest
        case ["(", *rest]:
            value, rest = _either(rest, symbols)
            if rest[:1] != [")"]:
                raise ValueError("open parenthesis")
            return value, rest[1:]
        case [word, *rest] if re.fullmatch(r"[^\W\d]\w*", word):
            return word == "true" or word != "false" and word in symbols, rest
    raise ValueError("no operand")


def _chain(lower, join: dict):
    """The parser of operands that ``lower`` reads with any of the operators ``join`` between them, from the left."""

    def parse(tokens, symbols):
        value, rest = lower(tokens, symbols)
        while rest and rest[0] in join:
            other, after = lower(rest[1:], symbols)
            value, rest = join[rest[0]](value, other), after
        return value, rest

    return parse


_equal = _chain(_unary, {"==": lambda a, b: a == b, "!=": lambda a, b: a != b})
_both = _chain(_equal, {"&&": lambda a, b: a and b})
_either = _chain(_both, {"||": lambda a, b: a or b})


def active(text: str, symbols: frozenset[str] = frozenset()) -> str:
    """The text with inactive lines and directives blanked; line numbers stay."""
    out, stack = [], []  # each open #if: (outer was active, a branch was taken, this branch is active)
    for line in text.split("\n"):
        m = re.match(r"\s*#\s*(if|elif|else|endif)\b(.*)", line)
        on = all(s[2] for s in stack)
        if not m:
            out.append(line if on else "")
            continue
        word, rest = m[1], m[2].split("//")[0]
        if word == "if":
            value = on and evaluate(rest, symbols)
            stack.append((on, value, value))
        elif stack and word == "endif":
            stack.pop()
        elif stack:
            outer, taken, _ = stack[-1]
            value = outer and not taken and (word == "else" or evaluate(rest, symbols))
            stack[-1] = (outer, taken or value, value)
        out.append("")
    return "\n".join(out)


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings stay untouched."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out, flags=re.S)


def compiler_options(text: str) -> dict:
    """baseUrl, paths and extends of a tsconfig text; empty if it is no JSON object."""
    try:
        own = json.loads(strip_jsonc(text))
    except ValueError:
        return {}
    if not isinstance(own, dict):
        return {}
    options = own.get("compilerOptions") or {}
    return {"extends": own.get("extends"), "baseUrl": options.get("baseUrl"), "paths": options.get("paths") or {}}


def package_target(entry, conditions: tuple[str, ...]) -> list[str]:
    """Targets of an exports or imports entry: the first condition that holds in key order; arrays add up; null gives none."""
    if isinstance(entry, str):
        return [entry]
    if isinstance(entry, list):
        return [t for e in entry for t in package_target(e, conditions)]
    for key, value in (entry or {}).items():
        if key == "default" or key in conditions:
            return package_target(value, conditions)
    return []


def package_match(table: dict, specifier: str, conditions: tuple[str, ...]) -> list[str]:
    """Exact key first, else the pattern with the longest prefix, then the longest suffix; ``*`` takes the rest."""
    if specifier in table and "*" not in specifier:
        return package_target(table[specifier], conditions)
    best = None
    for key in table:
        if key.count("*") == 1:
            head, tail = key.split("*")
            if specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail):
                rank = (len(head), len(tail))
                if best is None or rank > best[0]:
                    best = (rank, key, specifier[len(head) : len(specifier) - len(tail) or None])
    return [t.replace("*", best[2]) for t in package_target(table[best[1]], conditions)] if best else []


def argument_count(signature: str) -> int | None:
    """Arguments of a signature ``(...)->result``: commas outside all inner brackets and one more; None for text of another shape."""
    m = re.match(r"\((.*?)\)->", signature, re.S)
    if not m:
        return None
    depth, commas = 0, 0
    for c in m[1]:
        depth += (c in "<([") - (c in ">)]")
        commas += c == "," and not depth
    return commas + 1 if m[1].strip() else 0


def template_reads(html: str) -> list[tuple[str, int]]:
    """(name, line) of the identifiers that ``{{ }}``, [bound], (event) and *structural attributes read."""
    out = []
    for m in re.finditer(r"\{\{(.*?)\}\}|[\[(*][\w.-]+[\])]?\s*=\s*\"([^\"]*)\"", html, re.S):
        body = m[1] if m[1] is not None else m[2]
        clean = re.sub(r"'[^']*'|\"[^\"]*\"", lambda s: " " * len(s[0]), body)
        for w in re.finditer(r"(?<![\w.$?])([A-Za-z_$][\w$]*)", clean):
            if w[1] not in ("let", "of", "as", "true", "false", "null", "undefined", "this"):
                out.append((w[1], html.count("\n", 0, m.start(1 if m[1] is not None else 2) + w.start()) + 1))
    return out


def crate_roots(text: str) -> list[tuple[str, str]]:
    """(kind, path) of the targets that a Cargo manifest names or implies."""
    try:
        own = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    out = [("lib", own.get("lib", {}).get("path", "src/lib.rs"))] if "package" in own else []
    for kind in ("bin", "test", "example", "bench"):
        folder = {"bin": "src/bin", "test": "tests", "example": "examples", "bench": "benches"}[kind]
        out += [(kind, t.get("path", f"{folder}/{t.get('name', 'main')}.rs")) for t in own.get(kind, [])]
    return out


def facts(path: str, text: str) -> Iterator[tuple[str, int, str, str]]:
    """(family, line, kind, name) of a file's definitions and imports."""
    language = LANGUAGE.get(path.rpartition(".")[2].lower())
    if language is None:
        return
    for number, line in enumerate((active(text) if language == "cs" else text).split("\n"), 1):
        if m := DEFINITION[language].match(line):
            yield "definition", number, m[1], m[2]
        elif m := IMPORT[language].match(line):
            yield "import", number, m[1] or "", m[2]


def over_files(tree: DataFrame, scan: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``scan(path, text)`` over a table (path, text); ``schema`` starts with the path."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for r in scan(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return tree.select("path", "text").mapInPandas(run, schema)


def source_facts(tree: DataFrame) -> DataFrame:
    return over_files(tree, facts, "path string, family string, line int, kind string, name string")


def template_facts(tree: DataFrame) -> DataFrame:
    return over_files(tree, lambda _, t: iter(template_reads(t)), "path string, name string, line int")


def project_references(tree: DataFrame) -> DataFrame:
    """(path, reference, test) of project files: their references, and whether they name a test kit."""
    rows = tree.filter(F.lower("path").endswith(".csproj"))
    refs = F.regexp_extract_all("text", F.lit(r'<ProjectReference\s+Include="([^"]+)"'), 1)
    test = F.col("text").rlike(r"Microsoft\.NET\.Test\.Sdk|<IsTestProject>\s*true")
    return rows.select("path", F.explode_outer(refs).alias("reference"), test.alias("test")).withColumn("reference", F.translate("reference", "\\", "/"))
