"""Writers: full-refresh tables, the embedding cache, JSON exports, Markdown and comment rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalars import blank_to_null


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, partition: list[str] | None = None) -> None:
    """Replaces the table; sorted inside its files, so that min/max statistics prune (SNK1-SNK3)."""
    out = df.sortWithinPartitions(*sort) if sort else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_embedding_cache(vectors: DataFrame, path: str, model: str, dim: int, kind: str) -> None:
    """Overwrites the cache partition of (model, dim, kind); names must be plain (SNK4)."""
    for part in (model, kind):
        if not re.fullmatch("[a-zA-Z0-9_-]+", part):
            raise ValueError(f"not a plain name: {part}")
    rows = vectors.withColumn("model", F.lit(model)).withColumn("dim", F.lit(dim)).withColumn("kind", F.lit(kind))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "dim", "kind").parquet(path)


def upsert_documents(documents: DataFrame, path: str) -> None:
    """Rewrites the compounds that occur in documents and leaves the others (SNK6)."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("compound").parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as JSON with its null fields (SNK5)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def markdown_list(df: DataFrame, group: str, line: Column, order: list[str]) -> DataFrame:
    """group, text: a heading and one bullet for each row (SNK7)."""
    rows = df.select(group, F.struct(*order, F.concat(F.lit("- "), line).alias("_line")).alias("s")).groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(group, F.concat_ws("\n", F.concat(F.lit("## "), F.col(group).cast("string")), F.lit(""), F.array_join(F.transform("s", lambda x: x["_line"]), "\n")).alias("text"))


def comment_block(head: Column, brief: Column, details: Column, params: Column, returns: Column, notes: Column) -> Column:
    """A documentation comment: `/**`, one tag a field, `*/` (SNK8)."""
    tags = F.transform(F.map_entries(params), lambda e: F.concat(F.lit("@param "), e["key"], F.lit(" "), e["value"]))
    field = lambda tag, c: F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(tag), c))
    text = F.concat_ws(
        "\n\n", F.concat_ws("\n", field("@fn ", head), field("@brief ", brief)), blank_to_null(details),
        blank_to_null(F.array_join(tags, "\n")), field("@return ", returns), field("@note ", notes),
    )
    return F.concat(F.lit("/**\n * "), F.replace(text, F.lit("\n"), F.lit("\n * ")), F.lit("\n */"))
