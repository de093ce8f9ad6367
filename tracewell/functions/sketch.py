"""One-line sketches of tool results, by the kind of tool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ERROR_LINE, SPACE, collapse, count_lines, first_string, nonnull, paths_in, truncate

# How definitions and imports begin in common languages.
DEFINITIONS = (
    r"export (?:default )?(?:async )?(?:function|class|const|let|var|interface|type|enum) (\w+)",
    r"(?m)^(?:async )?def (\w+)",
    r"(?m)^class (\w+)",
    r"(?m)^func (\w+)",
    r"(?m)^(?:pub )?fn (\w+)",
)
IMPORT = r"(?m)^\s*(?:import\s|from\s+\S+\s+import\s|#include\s|using\s)"
REQUIRE = r"\brequire\("
EXIT_CODE = r"(?i)exit(?:ed with)?\s+code:?\s*(\d+)"


def head_of(text: Column, n: int) -> Column:
    return collapse(F.substring(text, 1, n))


def tail_of(text: Column, n: int) -> Column:
    return collapse(F.right(text, F.lit(n)))


def line_where(text: Column, holds, n: int) -> Column:
    """The first line for which holds() is true, on n characters; null if there is none."""
    return truncate(collapse(F.get(F.filter(F.split(text, "\n"), holds), F.lit(0))), n)


def first_line(text: Column, n: int) -> Column:
    return truncate(collapse(F.substring_index(text, "\n", 1)), n)


def first_error(text: Column, n: int) -> Column:
    found = line_where(text, lambda x: x.rlike(ERROR_LINE), n)
    return F.when(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(ERROR_LINE))) > 0, found).otherwise(first_line(text, n))


def symbols_defined(text: Column, most: int = 8) -> Column:
    found = [F.regexp_extract_all(text, F.lit(d), F.lit(1)) for d in DEFINITIONS]
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def short_path(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(F.length(path) <= 40, path).when(base != "", base).otherwise(F.right(path, F.lit(40)))


def files_in(text: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(paths_in(text), 1, most), short_path), ",")


def part(name: str, value: Column) -> Column:
    """name=value, or nothing for an empty value."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))


def assemble(*parts: Column, most: int = 240) -> Column:
    return truncate(collapse(F.concat_ws("; ", *parts)), most)


def sketch(tool: Column, input_json: Column, result: Column, is_error: Column, head: int = 100, tail: int = 60, most: int = 240) -> Column:
    """At most `most` characters that tell what a result holds; errors first, then by the tool's kind."""
    result, name = nonnull(result), F.lower(tool)
    bare = F.regexp_replace(result, "(?m)^[\t-\r ]*[0-9]+[\t→]", "")
    path = first_string(input_json, "file_path", "notebook_path", "path")
    lines = part("lines", count_lines(result).cast("string"))
    head_, tail_ = part("head", head_of(result, head)), part("tail", tail_of(result, tail))
    imports = F.regexp_count(bare, F.lit(IMPORT)) + F.regexp_count(bare, F.lit(REQUIRE))
    first_text = line_where(bare, lambda x: F.regexp_replace(x, SPACE, "") != "", 80)
    shapes = {
        ("read", "notebookread"): [part("path", path), lines, part("symbols", F.array_join(symbols_defined(bare), ",")), part("imports", imports.cast("string")), part("head", first_text)],
        ("grep", "glob", "ls"): [part("matches", count_lines(result).cast("string")), part("files", files_in(result, 6)), part("pattern", truncate(collapse(first_string(input_json, "pattern")), 60))],
        ("bash",): [part("cmd", truncate(collapse(first_string(input_json, "command")), 80)), part("exit", F.regexp_extract(result, EXIT_CODE, 1)), lines, part("files", files_in(result, 4)), part("head", head_of(result, 100)), part("tail", tail_of(result, 60))],
        ("edit", "write", "multiedit"): [part("path", path), part("result", first_line(result, 100))],
        ("webfetch", "websearch"): [part("url", truncate(collapse(first_string(input_json, "url", "query", "prompt")), 100)), part("head", head_of(result, 120))],
        ("agent", "task"): [part("head", head_of(result, 120)), part("tail", tail_of(result, 60))],
    }
    failed = F.coalesce(is_error, F.lit(False)) | F.trim(F.substring_index(result, "\n", 1)).rlike(ERROR_LINE)
    out = F.when(failed, assemble(F.concat(F.lit("ERR: "), first_error(result, 120)), part("tail", tail_of(result, 60)), most=most))
    for names, parts in shapes.items():
        out = out.when(name.isin(*names), assemble(*parts, most=most))
    return out.otherwise(assemble(head_, tail_, most=most))
