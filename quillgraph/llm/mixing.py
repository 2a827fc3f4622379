"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed over cells (source, language, topic). Starting from the cells' token shares, weights are scaled to the
target marginal of each of the three in turn, for a fixed number of rounds (raking). A document's inclusion
probability is its cell's weight times the sample's token budget over the cell's tokens, at most 1; what that cap takes
goes into the document's weight, so that weighted tokens keep the marginals. Documents are drawn by a hash of their id.

Default targets temper each marginal (shares to the power `temper`, normalised): that lifts small sources, languages
and topics. The default topic is a document's register, from its words for each sentence mark. All documents are counted
with map-side combine; the table of cells is broadcast only if it was counted to be small.

Defined results: null source, language or text count as empty strings; empty documents have 0 tokens, probability 1 and weight
1; a null id hashes as the empty string; repeated rows are drawn together; an empty table gives no rows; further columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import forget_shuffles
from quillgraph.session import materialize, release

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def register(text: Column, tokens: Column) -> Column:
    """Topic by words for each full stop in the whole text: terse, plain, long or none."""
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return (
        F.when(F.coalesce(stops, F.lit(0)) == 0, "none").when(tokens < stops * 6, "terse").when(tokens < stops * 9, "plain").otherwise("long")
    )


def rake(cells: DataFrame, rounds: int = 8, temper: float = 0.7) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with w, the fitted share of each cell."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for m in MARGINS:
        # The targets' normaliser is a sum over the distinct values, brought along by the driver as one number.
        shares = cells.groupBy(m).agg(F.pow(F.sum("tokens") / F.lit(float(total)), F.lit(temper)).alias(f"t_{m}"))
        norm = shares.agg(F.sum(f"t_{m}")).first()[0] or 1.0
        out = out.join(shares.withColumn(f"t_{m}", F.col(f"t_{m}") / F.lit(norm)), m)
    out = materialize(out, "cells", shrink=16)
    for k in range(rounds):
        for m in MARGINS:
            sums = out.groupBy(m).agg(F.sum("w").alias("s"))
            # A small table each time: the next step reads it twice, so the plan must not grow.
            step = materialize(out.join(sums, m).withColumn("w", F.col("w") * F.col(f"t_{m}") / F.col("s")).drop("s"), "cells", shrink=16)
            release(out)
            out = step
        if k % 4 == 0:
            forget_shuffles(cells.sparkSession)
    return out.select(*MARGINS, "tokens", "w")


def _mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    fraction: float = 0.5,
    rounds: int = 8,
    temper: float = 0.7,
    most_cells: int = 50_000,
) -> DataFrame:
    """The columns of docs as c0, c1, ..., then topic, n_tokens, prob, weight and sampled."""
    n = len(docs.columns)
    at = {c: f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col, lang_col)}
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    tokens = token_count(F.col(at[text_col]))
    plain = plain.withColumn("n_tokens", tokens).select(
        "*",
        F.coalesce(F.col(at[source_col]), F.lit("")).alias("source"),
        F.coalesce(F.col(at[lang_col]), F.lit("")).alias("lang"),
        (topic if topic is not None else register(F.col(at[text_col]), F.col("n_tokens"))).alias("topic"),
    )
    cells = materialize(
        plain.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells", shrink=16
    )
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rates = rake(cells, rounds, temper).select(*MARGINS, (F.col("w") * F.lit(float(total) * fraction) / F.col("tokens")).alias("rate"))
    if rates.limit(most_cells + 1).count() <= most_cells:
        rates = F.broadcast(rates)
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("n_tokens") > 0, F.col("rate"))
    prob = F.coalesce(F.least(rate, F.lit(1.0)), F.lit(1.0))
    return plain.join(rates, list(MARGINS), "left").select(
        *[f"c{i}" for i in range(n)],
        "topic",
        "n_tokens",
        prob.alias("prob"),
        F.coalesce(F.greatest(rate, F.lit(1.0)), F.lit(1.0)).alias("weight"),
        (draw < prob).alias("sampled"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with topic, n_tokens, prob, weight and sampled appended; fraction: the sample's share of all tokens."""
    return _mixed(docs, **options).toDF(*docs.columns, "topic", "n_tokens", "prob", "weight", "sampled")


def op4(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "topic", "n_tokens", F.round("prob", 6).alias("prob"), F.round("weight", 6).alias("weight"), "sampled")


def sample(docs: DataFrame) -> DataFrame:
    """The drawn documents with their columns, then n_tokens and the weight that calibrates them."""
    drawn = _mixed(docs).where("sampled").withColumn("weight", F.round("weight", 6))
    return drawn.drop("topic", "prob", "sampled").toDF(*docs.columns, "n_tokens", "weight")


def sql(docs: str, rounds: int = 8) -> str:
    """The DuckDB form of mix() over the relation docs, as WITH members that end in mix_rows."""
    parts = [
        f"""mix_docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_tokens,
  CASE WHEN coalesce(stops, 0) = 0 THEN 'none' WHEN n_tokens < stops * 6 THEN 'terse' WHEN n_tokens < stops * 9 THEN 'plain' ELSE 'long' END AS topic,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens,
    length(text) - length(replace(text, '.', '')) AS stops FROM {docs}))""",
        """mix_c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM mix_docs GROUP BY ALL HAVING sum(n_tokens) > 0)""",
        """mix_t AS (SELECT sum(tokens) AS total FROM mix_c)""",
    ]
    for m in MARGINS:
        parts.append(
            f"mix_g_{m} AS (SELECT {m}, t / sum(t) OVER () AS t_{m} FROM (SELECT {m}, pow(sum(tokens) / any_value(total), 0.7) AS t FROM mix_c, mix_t GROUP BY {m}))"
        )
    parts.append(
        "mix_w0 AS (SELECT mix_c.*, tokens / total AS w, t_source, t_lang, t_topic FROM mix_c, mix_t JOIN mix_g_source USING (source) JOIN mix_g_lang USING (lang) JOIN mix_g_topic USING (topic))"
        .replace("mix_c, mix_t JOIN", "mix_c CROSS JOIN mix_t JOIN")
    )
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"mix_w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM mix_w{k})")
            k += 1
    parts.append(
        f"""mix_rows AS (SELECT d.doc_id, d.topic, d.n_tokens, least(r, 1.0) AS prob, greatest(r, 1.0) AS weight, d.draw < least(r, 1.0) AS sampled
  FROM (SELECT x.*, CASE WHEN n_tokens > 0 THEN coalesce(w * total * 0.5 / tokens, 1.0) ELSE 1.0 END AS r
    FROM mix_docs x CROSS JOIN mix_t LEFT JOIN mix_w{k} USING (source, lang, topic)) d)"""
    )
    return ",\n".join(parts)
