"""Fields in formula texts, by column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import camel_to_snake, snake_to_camel

# Words of formulas that are no fields.
STOP_WORDS = (
    "case when then else end null is not and or in like coalesce nvl abs sum min max avg count distinct "
    "true false between over partition by row_number dense_rank rank lead lag order group having "
    "on join inner left right full outer union all exists any some as"
).split()
# Plain lower-case words that are no fields either.
COMMON_WORDS = (
    "select from where insert update delete create drop alter limit offset desc asc into values set table index "
    "char varchar text int bigint decimal date time timestamp year month day hour minute second"
).split()


def _words(formula: Column) -> Column:
    """The words of a formula that aren't quoted, of dotted names the last part, without stop words."""
    bare = F.regexp_replace(F.regexp_replace(formula, "'[^']*'", " "), "[^A-Za-z0-9_.]", " ")
    words = F.transform(F.split(F.trim(bare), r"\s+"), lambda w: F.when(w.endswith("."), w).otherwise(F.substring_index(w, ".", -1)))
    return F.filter(words, lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(w).isin(STOP_WORDS))


def _field_of(word: Column) -> Column:
    """The field that a word stands for in camel case; empty for none."""
    camel = lambda w: w.rlike("^[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$")
    plain = lambda w: w.rlike("^[a-z][a-z0-9]+$") & ~w.isin(COMMON_WORDS)
    return F.when(word.contains("_"), snake_to_camel(word)).when(camel(word) | plain(word), word).otherwise("")


def extract_sequence(formula: Column) -> Column:
    """The fields in a formula in camel case, each at its first place; an empty array for null.

    Quoted texts don't count. Of a dotted name the last part counts. Words in snake case are converted; camel-case words and lower-case
    words of two letters and more stay; stop words, single letters and words that begin with a capital are dropped.
    """
    named = F.transform(_words(formula), _field_of)
    return F.coalesce(F.array_distinct(F.filter(named, lambda w: w != "")), F.array().cast("array<string>"))


def extract_fields(formula: Column) -> Column:
    """The set of fields in a formula, sorted."""
    return F.array_sort(extract_sequence(formula))


def formula_refs(formula: Column) -> Column:
    """The set of names of the fields in a formula, as they are spelt there and in camel case, sorted."""
    words = F.filter(_words(formula), lambda w: _field_of(w) != "")
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(words, F.transform(words, _field_of)))), F.array().cast("array<string>"))


def extract_words(formula: Column) -> Column:
    """All runs of letters, digits and underscores."""
    return F.regexp_extract_all(formula, F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def all_formulas(trigger: Column, expression: Column, virtual: Column) -> Column:
    return F.concat_ws(" ", trigger, expression, virtual)


def contains_run(hay: Column, needle: Column) -> Column:
    """Whether needle's elements follow each other in hay without gap; an empty needle is nowhere."""
    # Elements hold no commas, so lists can be compared as texts.
    text = lambda a: F.concat(F.lit(","), F.array_join(a, ","), F.lit(","))
    return (F.size(needle) > 0) & F.contains(text(hay), text(needle))


def contains_word(text: Column, word: Column) -> Column:
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"\b"), F.lower(word), F.lit(r"\b")))


def formula_to_columns(formula: Column, names: Column) -> Column:
    """The formula with fields replaced by column names: names is a map from canonical field to catalog name.

    Only fields that the formula holds and the map knows change, longest first, as whole words without a dot before them.
    """
    known = F.filter(F.map_keys(names), lambda k: F.array_contains(extract_sequence(formula), k))
    longest_first = F.reverse(F.array_sort(F.transform(known, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))))

    def step(text: Column, field: Column) -> Column:
        column = F.coalesce(F.element_at(names, field["k"]), camel_to_snake(field["k"]))
        return F.regexp_replace(text, F.concat(F.lit(r"(?<![.\w])"), field["k"], F.lit(r"\b")), column)

    return F.aggregate(longest_first, formula, step)
