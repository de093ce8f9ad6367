"""Terms of queries and records, and how well they match, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nonnull

# What a term is in lower case and as written, what separates its parts, and what ends a sentence after it.
TERM = r"[a-z0-9_$][a-z0-9_$.\-/\\]+"
RAW_TERM = r"[A-Za-z0-9_$][A-Za-z0-9_$.\-/\\]*"
SEPARATOR = r"[_.\-/\\]"
SENTENCE_END = r"[.:,;]+$"
# Shapes of names in code, by what a term must have and what it must not be (null: anything). Mixed case,
# three capitals or more, parts that something joins other than a number's, and numbers of three signs or more.
CODE_SHAPES = (
    (r"[a-z][A-Z]", None),
    (r"^(?=.*[A-Z])[A-Z0-9_$]{3,}$", None),
    (r"[A-Za-z0-9][_$./\\\-][A-Za-z0-9$]", r"^[0-9.\-/]+$"),
    (r"^(?=.{3})[^A-Za-z]*[0-9][^A-Za-z]*$", None),
)

# Words that no search needs.
STOP_WORDS = """
the a an and or but if then else of to in on at for from by with without into onto over under
as is are was were be been being am do does did done have has had having can could should
would will shall may might must not no nor so than that this these those there here it its i
me my we our you your he she they them their what which who whom whose when where why how all
any some more most much many few very just also again still yet now new old only own same
other another each every both either neither because while before after until since about
above below between through during against out up down off further once please let make get
got need needs want wants try trying cannot use using used run running ran file files code
""".split()

# Words of plain prose, which anchor nothing.
PROSE_WORDS = """
say said says tell told tells know knows knew show shows showed give gives gave take takes took
come came comes went goes going look looks looked think thought thinks find found finds see seen
sees seem seems seemed work works worked mean means meant way ways thing things something anything
everything nothing information detail details value values field fields name names type types
return returns returned answer answers question questions context earlier later already before
above below check checks checked change changes changed explain explains describe describes
summarize summary list lists write writes wrote read reads update updates updated fix fixes fixed
add adds added remove removes removed create creates created delete deletes deleted help helps
understand understood exactly actually really right wrong good bad best worst same different
without within where which what when whether while
""".split()


def _words(listed: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in listed])


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(nonnull(text)), F.lit(TERM), F.lit(0)))


def stem(term: Column) -> Column:
    """Common endings removed; identifiers are left alone."""
    n = F.length(term)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    return (
        F.when(term.rlike(r"[_.\-/\\0-9]"), term)
        .when((n >= 6) & term.endswith("ing"), cut(3))
        .when((n >= 5) & term.endswith("ed"), cut(2))
        .when((n >= 5) & term.endswith("es") & ~term.endswith("ses"), cut(1))
        .when((n >= 4) & term.endswith("s") & ~term.endswith("ss"), cut(1))
        .otherwise(term)
    )


def query_terms(text: Column) -> Column:
    """Terms worth a search, each with its stem."""
    kept = F.filter(terms_of(text), lambda t: (F.length(t) >= 3) & ~F.array_contains(_words(STOP_WORDS), t))
    stems = F.filter(F.transform(kept, stem), lambda t: F.length(t) >= 3)
    return F.array_union(kept, stems)


def code_terms(text: Column) -> Column:
    """Terms that have one of CODE_SHAPES as they are written, in lower case."""
    written = F.transform(F.regexp_extract_all(nonnull(text), F.lit(RAW_TERM), F.lit(0)), lambda t: F.regexp_replace(t, SENTENCE_END, ""))
    shaped = lambda t: reduce(or_, [t.rlike(has) if never is None else t.rlike(has) & ~t.rlike(never) for has, never in CODE_SHAPES])
    return F.array_distinct(F.transform(F.filter(written, shaped), F.lower))


def components_of(code: Column) -> Column:
    parts = F.flatten(F.transform(code, lambda t: F.filter(F.split(t, r"[_$./\\\-]+"), lambda p: (F.length(p) >= 4) & (p != t) & ~F.array_contains(_words(STOP_WORDS), p))))
    return F.array_distinct(parts)


def is_prose(term: Column) -> Column:
    return term.isin(*PROSE_WORDS)
