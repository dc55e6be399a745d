"""Answer and label matching expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlake.functions.text import BLANKS, strip

_WORD = r"(?U)\b\Q{}\E\b"


def exact_match(answer: Column, targets: Column) -> Column:
    """1 if the stripped lower-case answer is one of the targets."""
    return F.array_contains(targets, F.lower(strip(answer))).cast("int")


def contain_match(answer: Column, targets: Column) -> Column:
    """1 if any target is part of the lower-case answer; an empty target always is."""
    lowered = F.lower(answer)
    return F.exists(targets, lambda t: F.contains(lowered, t)).cast("int")


def word_match(answer: Column, targets: Column) -> Column:
    """1 if any target stands in the answer as a whole word."""
    pattern = lambda t: F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b"))
    return F.exists(targets, lambda t: F.regexp_like(answer, pattern(t))).cast("int")


def parse_label(text: Column, labels: Sequence[str] | Column) -> Column:
    """The label a free answer means, else the answer as it is.

    In order: the whole answer is the label; the answer begins with it; exactly
    one label stands in it as a word; a label of two or more characters stands
    between blanks. Among several labels the first listed wins. Labels given as
    literals let the patterns be compiled once.
    """
    answer = F.rtrim(strip(F.lower(text)), F.lit(".,!?:"))
    spaced = F.concat(F.lit(" "), answer, F.lit(" "))
    if isinstance(labels, Column):
        pick = lambda test: F.filter(labels, lambda x: test(F.lower(x)))
        words = pick(
            lambda x: F.regexp_like(answer, F.concat(F.lit(r"(?U)\b\Q"), x, F.lit(r"\E\b")))
        )
        none = F.coalesce(F.size(labels), F.lit(0)) == 0
    else:
        pick = lambda test: F.array_compact(
            F.array(*[F.when(test(F.lit(x.lower())), F.lit(x)) for x in labels])
        )
        words = F.array_compact(
            F.array(*[F.when(answer.rlike(_WORD.format(x.lower())), F.lit(x)) for x in labels])
        )
        none = F.lit(not labels)
    first = lambda arr: F.get(arr, F.lit(0))
    found = F.coalesce(
        first(pick(lambda x: answer == x)),
        first(pick(lambda x: F.startswith(answer, x))),
        F.when(F.size(words) == 1, first(words)),
        first(
            pick(
                lambda x: (F.length(x) > 1)
                & F.contains(spaced, F.concat(F.lit(" "), x, F.lit(" ")))
            )
        ),
        text,
    )
    return F.when(none, text).otherwise(found)


def three_way_label(truth: Column) -> Column:
    """Written verdict to class: yes anywhere is 0, a leading no is 2, the rest 1."""
    lowered = F.lower(truth)
    return (
        F.when(F.contains(lowered, F.lit("yes")), F.lit("0"))
        .when(F.startswith(lowered, F.lit("no")), F.lit("2"))
        .otherwise(F.lit("1"))
    )


def same_label(prediction: Column, truth: Column) -> Column:
    """1 if both texts are equal after stripping; null counts as empty."""
    clean = lambda c: F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit(""))
    return (clean(prediction) == clean(truth)).cast("int")
