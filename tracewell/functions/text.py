"""Text functions as column expressions: they run inside generated code and read the same in SQL.

Lengths count code points; white space and letters are those of ASCII.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r ]"
#: Something like a path: folders, then a name with an extension of up to eight characters.
PATH = r"(?:[A-Za-z]:)?(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}"
#: The same matches: a path begins where its first folder's name does or at a drive's letter, and names are never shortened before a slash.
_PATH = r"(?:(?<![A-Za-z0-9_.-])|(?=[A-Za-z]:))(?:[A-Za-z]:)?+(?:[A-Za-z0-9_.-]++[\\/])+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}"
#: The same in a text without two slashes in a row, in linear time and without recursion: a path goes on to the last name with an extension, and where its first folder begins none, no later folder does.
_LONG_PATH = r"(?:(?<![A-Za-z0-9_.-])(?<![A-Za-z0-9_.-][\\/])|(?=[A-Za-z]:))(?:[A-Za-z]:)?+[A-Za-z0-9_.-]++[\\/](?:[A-Za-z0-9_.\\/-]*[\\/])?[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}"
#: No path goes over two slashes in a row.
_SLASHES = r"([\\/])(?=[\\/])"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
CODE_LIKE = r"[A-Z_$0-9]"
# Words that mark a line as an error.
ERROR_LINE = r"\b(Error|Exception|FAIL|failed|panic|Traceback|errno|ENOENT|EACCES|TypeError|ReferenceError|SyntaxError)\b"
ERROR_CLASS = r"\b[A-Z][A-Za-z]*Error\b"
#: Every text with an error line or class has one of these pieces.
_ERROR_PIECES = ("Error", "Exception", "FAIL", "failed", "panic", "Traceback", "errno", "ENOENT", "EACCES")
FAILURE_WORD = r"(?i)\b(?:fail(?:ed|ure|ing)?|error|exception|traceback|panic)\b"

# Identifiers too common to refer to anything.
COMMON_IDENTIFIERS = (
    "function return const export import undefined string number boolean object module default require interface extends "
    "implements typeof instanceof static public private protected readonly async await class enum type let var new this "
    "super null true false void yield delete throw switch case break continue while for do if else try catch finally "
    "namespace declare abstract override satisfies keyof infer unknown never symbol bigint promise array record map set "
    "error console global window document package in of as from"
).split()


def no_strings() -> Column:
    return F.array().cast("array<string>")


def nonnull(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def token_marks(text: Column) -> Column:
    """A text with an `a` for every six letters of a word and without white space: what its tokens are counted from."""
    return F.regexp_replace(F.regexp_replace(nonnull(text), "[A-Za-z]{1,6}", "a"), r"[\t-\r ]+", "")


def tenths_of_marks(marks: Column) -> Column:
    """token_tenths() of a text's marks: 9 for each, 1 more for an `a` and 4 less for a digit. Whole runs are cut out, since to list matches costs far more."""
    left = lambda pattern: F.length(F.regexp_replace(marks, pattern, ""))
    return F.length(marks) * 9 + left("[^a]+") - left("[^0-9]+") * 4


def token_tenths(text: Column) -> Column:
    """Ten times the tokens of a text: 10 for every six letters of a word, 5 for a digit, 9 for any other sign. Whole numbers, so every engine agrees."""
    return tenths_of_marks(token_marks(text))


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text, rounded up."""
    return rounded_up(token_tenths(text))


def rounded_up(tenths: Column) -> Column:
    return F.floor((tenths + 9) / F.lit(10)).cast("long")


def tokens_in_all(texts: Column) -> Column:
    """The sum of the tokens of an array's texts, each rounded up. Marks come first: inside a function of an array nothing is computed once for two uses."""
    return F.aggregate(F.transform(texts, token_marks), F.lit(0).cast("long"), lambda n, m: n + rounded_up(tenths_of_marks(m)))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def abridge(text: Column, head: int = 400, tail: int = 150) -> Column:
    """Head and tail of a text that is longer than both by over 40."""
    left_out = F.length(text) - head - tail
    note = F.concat(F.lit("\n[… "), left_out.cast("string"), F.lit(" chars omitted …]\n"))
    return F.when(F.length(text) <= head + tail + 40, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(nonnull(text), SPACE + "+", " "))


def normal_path(path: Column) -> Column:
    plain = F.lower(F.translate(path, "\\", "/"))
    return F.when(plain.startswith("./"), F.substr(plain, F.lit(3))).otherwise(plain)


def paths_in(text: Column) -> Column:
    """Distinct normalised paths of a text, in order of appearance. No path goes over a blank, and a word without a slash of either kind has none."""
    slashed = lambda x: F.contains(x, F.lit("/")) | F.contains(x, F.lit("\\"))
    doubled = reduce(or_, [F.contains(text, F.lit(a + b)) for a in "/\\" for b in "/\\"])
    parted = F.when(doubled, F.regexp_replace(text, _SLASHES, "$1 ")).otherwise(text)
    words = F.array_distinct(F.filter(F.split(parted, " "), slashed))
    found = F.array_distinct(F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(_LONG_PATH), F.lit(0)))))
    return F.when(slashed(text), F.array_distinct(F.transform(found, normal_path))).otherwise(no_strings())


def symbols_in(text: Column, least: int = 6, most: int = 200) -> Column:
    """The first distinct identifiers that look like code."""
    return symbols_of(F.array_distinct(F.regexp_extract_all(nonnull(text), F.lit(IDENTIFIER), F.lit(0))), least, most)


def symbols_of(identifiers: Column, least: int = 6, most: int = 200) -> Column:
    """symbols_in(), of a text's distinct identifiers."""
    common = F.array(*[F.lit(w) for w in COMMON_IDENTIFIERS])
    kept = F.filter(identifiers, lambda w: (F.length(w) >= least) & w.rlike(CODE_LIKE) & ~F.array_contains(common, F.lower(w)))
    return F.slice(kept, 1, most)


def lines_in(text: Column) -> Column:
    return F.transform(F.split(nonnull(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def errors_in(text: Column) -> Column:
    """Error lines (120 characters) and the names of error classes."""
    marked = F.transform(F.filter(lines_in(text), lambda x: x.rlike(ERROR_LINE)), lambda x: truncate(x, 120))
    found = F.array_distinct(F.concat(marked, F.regexp_extract_all(text, F.lit(ERROR_CLASS), F.lit(0))))
    return F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in _ERROR_PIECES]), found).otherwise(no_strings())


def quotes_in(text: Column, least: int = 40, most: int = 100) -> Column:
    """The first distinct lines long enough to be quoted on purpose."""
    found = F.slice(F.array_distinct(F.filter(lines_in(text), lambda x: F.length(x) >= least)), 1, most)
    return F.when(F.length(text) >= least, found).otherwise(no_strings())


def tool_ids_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(nonnull(text), F.lit(IDENTIFIER), F.lit(0)))


def count_lines(text: Column) -> Column:
    """Lines of a text; a line break at its end begins none."""
    text = nonnull(text)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))


def json_string(json: Column, key: str) -> Column:
    """The value of a key of a JSON object as text; JSON without the key's letters (or a backslash, that could spell them) isn't parsed."""
    return F.when(F.contains(json, F.lit(key)) | F.contains(json, F.lit("\\")), F.get_json_object(json, f"$.{key}"))


def first_string(json: Column, *keys: str) -> Column:
    """The first of the keys of a JSON object that holds a non-empty string."""
    typed = [F.when(json_string(json, k) != "", json_string(json, k)) for k in keys]
    return F.coalesce(*typed)


def input_path(json: Column) -> Column:
    return first_string(json, "file_path", "path", "notebook_path", "filePath")


def canonical_json(json: Column) -> Column:
    """JSON with sorted keys; text that isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def content_hash(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of SHA-256 over the parts, between unit separators."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[nonnull(p) for p in parts]), 256), 1, 16)


def input_summary(json: Column) -> Column:
    """The telling field of a tool's input on one line of 80 characters, with the offset of a partial read."""
    offset = json_string(json, "offset").try_cast("long")
    shown = [F.concat(F.lit(f"{k}="), truncate(F.regexp_replace(first_string(json, k), SPACE + "+", " "), 80)) for k in ("file_path", "path", "command", "pattern", "url", "query", "prompt")]
    head = F.coalesce(*shown)
    return F.coalesce(F.when(offset > 1, F.concat(head, F.lit(" offset="), offset.cast("string"))).otherwise(head), F.lit(""))
