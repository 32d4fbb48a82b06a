"""Fuzzy ratios (0 to 100) as column expressions over short strings.

All are built on the normalised Indel similarity ``200 * lcs / (|a| + |b|)``.
The longest common subsequence is one nested fold: the outer fold walks the
first string and carries a row of the table, the inner one makes the next row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def lcs_length(a: Column, b: Column) -> Column:
    letters = _chars(b)
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def outer(row: Column, c: Column) -> Column:
        def inner(acc: Column, i: Column) -> Column:
            diagonal = F.element_at(row, i) + F.when(F.element_at(letters, i) == c, 1).otherwise(0)
            return F.concat(acc, F.array(F.greatest(diagonal, F.element_at(row, i + 1), F.element_at(acc, -1))))

        return F.aggregate(F.filter(F.sequence(F.lit(0), F.length(b)), lambda i: i > 0), F.array(F.lit(0)), inner)

    return F.element_at(F.aggregate(_chars(a), zero, outer), -1)


def ratio(a: Column, b: Column) -> Column:
    """C-17; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


def _sorted_tokens(x: Column) -> Column:
    return F.array_sort(F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != ""))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """C-18."""
    return ratio(F.array_join(_sorted_tokens(a), " "), F.array_join(_sorted_tokens(b), " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """C-19: the best of the shared words alone and with either rest; 0 if a side has no words."""
    left, right = F.array_distinct(_sorted_tokens(a)), F.array_distinct(_sorted_tokens(b))
    both = F.array_sort(F.array_intersect(left, right))
    only_left, only_right = F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
    shared = F.array_join(both, " ")
    with_left, with_right = (F.trim(F.concat_ws(" ", shared, F.array_join(x, " "))) for x in (only_left, only_right))
    subset = (F.size(both) > 0) & ((F.size(only_left) == 0) | (F.size(only_right) == 0))
    rest = F.greatest(ratio(with_left, with_right), F.when(F.size(both) > 0, F.greatest(ratio(shared, with_left), ratio(shared, with_right))).otherwise(0.0))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).when(subset, F.lit(100.0)).otherwise(rest)


def partial_ratio(a: Column, b: Column) -> Column:
    """C-20: the best ratio of the shorter string with any stretch of the longer one of its length, or cut shorter at either end."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n, m = F.length(short), F.length(long)
    starts = F.sequence(F.lit(1) - n + 1, m)
    pieces = F.transform(starts, lambda s: F.substr(long, F.greatest(s, F.lit(1)), F.least(s + n, m + 1) - F.greatest(s, F.lit(1))))
    best = F.array_max(F.transform(F.array_distinct(pieces), lambda p: ratio(short, p)))
    return F.when((n == 0) | (m == 0), F.when(n == m, F.lit(100.0)).otherwise(0.0)).otherwise(best)


def team_score(a: Column, b: Column) -> Column:
    """C-21: the better of token set and partial ratio of two normal forms; 0 if one is blank."""
    blank = (F.trim(a) == "") | (F.trim(b) == "")
    return F.when(blank, F.lit(0.0)).otherwise(F.greatest(token_set_ratio(a, b), partial_ratio(a, b)))
