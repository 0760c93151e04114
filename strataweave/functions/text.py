"""Text columns: trimming, tokens, set and positional similarity, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """All white space off both ends (``trim`` takes only blanks)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def norm(c: Column | str) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip(c))


def words(c: Column | str) -> Column:
    """White-space tokens, none empty; null text has no tokens."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\s+"), lambda t: t != "")


def token_count(c: Column | str) -> Column:
    return F.size(words(c))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(F.lower(_c(c))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places, of the longer length; 1 if both are empty."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    hits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: (i <= short) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))))
    return F.when(long_ == 0, F.lit(1.0)).otherwise(hits / long_)


def entity_id(label: Column | str, kind: Column | str) -> Column:
    """``ent_`` + 12 hex digits of SHA-256 of lower(strip(label))::lower(strip(kind))."""
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat(norm(label), F.lit("::"), norm(kind)), 256), 1, 12))


def relation_id(source: Column, target: Column, predicate: Column, seq: Column) -> Column:
    head = F.replace(F.substring(predicate, 1, 30), F.lit(" "), F.lit("_"))
    digest = F.sha2(F.concat_ws("::", source, target, norm(predicate), seq.cast("string")), 256)
    return F.concat(head, F.lit("_"), F.substring(digest, 1, 12))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
