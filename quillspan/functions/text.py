"""Text expressions: white space, slugs, names, similarity. All are built-in expressions but for the two Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: White space as the text rules mean it: Unicode's, and the four separators that Java leaves out.
WS = r"[\s\x1c-\x1f]"
_U = "(?U)"


def rtrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{_U}{WS}+$", "")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{_U}^{WS}+|{WS}+$", "")


def slug(label: Column, fallback: str = "involved_in") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one underscore, none at the ends; `fallback` for nothing."""
    s = F.regexp_replace(F.lower(trim_ws(F.coalesce(label, F.lit("")))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def plain_name(s: str | None) -> str:
    """Decomposed, without combining marks, case folded, punctuation to spaces, spaces collapsed."""
    if not s:
        return ""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in s).split())


@F.pandas_udf(StringType())
def normalize_name(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """plain_name() over Arrow batches; each distinct name of a batch is worked on once."""
    for s in names:
        distinct = {x: plain_name(x) for x in s.dropna().unique()}
        yield s.map(lambda x: distinct.get(x, ""))


def normalize_ascii(c: Column) -> Column:
    """The same for ASCII names, as built-in expressions."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z_]", " "), " +", " "))


def tokens(norm: Column) -> Column:
    """The distinct words of a normalised name; none for an empty one."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two normalised names; 0 if neither has one."""
    return F.size(F.array_intersect(tokens(a), tokens(b))) / F.greatest(F.lit(1), F.size(F.array_union(tokens(a), tokens(b))))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: the DP row as a fold over the letters of `a`, each cell from the one to its left."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    bs = letters(b)

    def row(old: Column, x: Column) -> Column:
        def cell(acc: Column, y: Column) -> Column:
            j = F.size(acc)
            up, left = F.element_at(old, j + 1), F.element_at(acc, -1)
            diagonal = F.element_at(old, j)
            return F.concat(acc, F.array(F.when(x == y, diagonal + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(bs, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(letters(a), F.array_repeat(F.lit(0), F.size(bs) + 1), row), -1)


def _lcs(a: str, b: str) -> int:
    """By bits: one integer holds a row, and one addition moves to the next."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(IntegerType())
def lcs_length_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def name_similarity(a: Column, b: Column, lcs: Column | None = None) -> Column:
    """0.6 of the words' Jaccard and 0.4 of the LCS over the longer name; 0 if either is empty."""
    lcs = lcs_length_arrow(a, b) if lcs is None else lcs
    score = F.lit(0.6) * token_jaccard(a, b) + F.lit(0.4) * (lcs / F.greatest(F.length(a), F.length(b)))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)
