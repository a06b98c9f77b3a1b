"""Text helpers shared by every operator. All return Spark columns; nothing runs per row in Python."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


FEW = 8  # lists up to this length are written out as one expression


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonblank(c: str | Column) -> Column:
    """True when the value is neither NULL nor blank text."""
    return F.coalesce(F.trim(col(c)) != "", F.lit(False))


def blank_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def strings(words: Sequence[str]) -> Column:
    """Array literal. An empty list stays a typed empty array."""
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _is_plain(c: Column) -> bool:
    """A bare column, which costs nothing to name many times; anything else should be computed once."""
    return re.fullmatch(r"Column<'[\w.]+'>", str(c)) is not None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


MARK = "\u0001"


def marked(text: Column) -> Column:
    """The text with a mark at both ends of every word, so that a marked keyword occurs in it only at the edges of words."""
    return F.regexp_replace(F.translate(text, MARK, " "), r"([\p{L}\p{N}_]+)", f"{MARK}$1{MARK}")


def mark(word: str) -> str:
    """The same for a word of a fixed list."""
    return re.sub(r"(\w+)", rf"{MARK}\1{MARK}", word.replace(MARK, " "))


def any_word(text: str | Column, words: Sequence[str]) -> Column:
    """Substring test against a short fixed list. A bare column gets one short-circuit OR, or for longer lists one
    array test, which keeps the generated method small enough to be compiled; a computed text is evaluated once and
    matched against one alternation of literals."""
    t = col(text)
    if not words:
        return F.lit(False)
    if _is_plain(t) and len(words) > FEW:
        return F.coalesce(F.exists(strings(words), lambda w: t.contains(w)), F.lit(False))
    if _is_plain(t):
        return F.coalesce(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), F.lit(False))
    return F.coalesce(t.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(False))


def count_words(text: str | Column, words: Sequence[str]) -> Column:
    """How many of the words occur (each counted once); NULL text counts 0."""
    def total(x: Column) -> Column:
        if len(words) > FEW:
            return F.when(x.isNotNull(), F.size(F.filter(strings(words), lambda w: x.contains(w))))
        return reduce(lambda a, b: a + b, [x.contains(w).cast("int") for w in words], F.lit(0))
    t = col(text)
    return F.coalesce(total(t) if _is_plain(t) else let(t, total), F.lit(0))


def found_words(text: str | Column, words: Sequence[str]) -> Column:
    """The words that occur, in list order; matching is done in lower case, the listed spelling is kept."""
    t = col(text)
    return F.filter(strings(words), lambda w: F.coalesce(t.contains(F.lower(w)), F.lit(False)))


def first_case(pairs: Sequence[tuple[Column, object]], default: object) -> Column:
    """Ordered CASE from (condition, value) pairs."""
    out = None
    for cond, val in pairs:
        val = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def lookup(key: str | Column, table: dict, default: object = None) -> Column:
    """Fixed small mapping as an ordered CASE (codegen, no join)."""
    k = col(key)
    return first_case([(k == a, b) for a, b in table.items()], default)


def map_of(table: dict[str, Sequence[str]]) -> Column:
    """Map literal category -> word array."""
    if not table:
        return F.create_map().cast("map<string,array<string>>")
    args: list[Column] = []
    for k, v in table.items():
        args += [F.lit(k), strings(v)]
    return F.create_map(*args)


def rows_of(array: str | Column) -> Column:
    """Explode a computed array column. Handed a bare column, Spark adds an emptiness test below the projection and
    computes the array a second time there; an expression is left alone."""
    return F.explode(F.filter(col(array), lambda x: x.isNotNull()))
