"""Tokens, postings and trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.wordlists import STOP_WORDS


def tokens(text: Column, drop_stop_words: bool = True) -> Column:
    """Distinct lower-case runs of a-z, 0-9 and _, without stop words (FN3)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS])) if drop_stop_words else found


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty (FN4)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def query_coverage(query: Column, doc: Column) -> Column:
    """Share of the query's tokens in the document's; 0 for an empty query (FN5)."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    padded = F.transform(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    )
    return F.array_distinct(
        F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    return token_jaccard(a, b)


def postings(rows: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, lexeme, weight) with a lexeme's largest field weight; one shuffle-free explode of distinct tokens."""

    def weighed(column: str, weight: float) -> Column:
        return F.transform(tokens(F.col(column), False), lambda t: F.struct(t.alias("lexeme"), F.lit(weight).alias("weight")))

    parts = [weighed(c, w) for c, w in fields.items()]
    return (
        rows.select(key, F.explode(F.concat(*parts)).alias("p"))
        .select(key, "p.lexeme", "p.weight")
        .groupBy(key, "lexeme")
        .agg(F.max("weight").alias("weight"))
    )
