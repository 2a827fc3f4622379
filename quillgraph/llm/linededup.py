"""Line deduplication by a log-template tree, in DataFrame functions only.

A line's tokens with a digit are variable fields and become `<*>`; the rest is its template. The tree has fixed depth: the
number of tokens, then the first `depth` template tokens; its leaves hold templates. A leaf has as many generalised
templates as its lines have families: a token that min_docs texts have in the same place of the leaf stays, any other token
becomes `<*>`, and lines that then are equal are one template, if `agree` of its places stay.

Templates, plain or generalised, that recur in at least min_docs different texts are dropped from every document; a line of
long_tokens or more recurs from 2 texts on. Near-copies of one another count as one text: they are left to document
deduplication, so the lines that only copies share stay. To find them, a text is compared with the shortest text of each
line that it shares with others, if at least a quarter of it is in lines shared with that text. The comparison is by the
sets of runs of four words: near-copies agree on eight tenths of all runs, or on four tenths of those outside the lines that
they share. Groups are the components of these links.

All steps are grouped counts with map-side combine on hashes of templates and texts; equal texts count once however often
they occur. The lists that are joined back have rows of fixed width and are broadcast only if they were counted to be few,
else shuffled.

Defined results: null text stays null with 0 lines; blank lines and lines of fewer than min_tokens tokens are never dropped;
repeated rows get equal results; ties between shortest texts go to the smaller hash; texts of any length are read whole;
an empty table gives no rows; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import components, forget_shuffles
from quillgraph.session import materialize, release

TOKEN = r"[^\x20\x09-\x0D]+"
#: A token with a digit, found from its start only, so that a long token is read once.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"
#: Numbers in a broadcast list.
BROADCAST_NUMBERS = 1_000_000


def _hash(text: Column) -> Column:
    """60 bits of the text's digest, which any SQL engine can make as well."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _template(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)


def _tokens(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(f"({TOKEN})"), 1)


def _few(rows: DataFrame) -> DataFrame:
    """Rows of numbers with a broadcast hint if they were counted to be few."""
    most = BROADCAST_NUMBERS // len(rows.columns)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _lines(texts: DataFrame, depth: int) -> DataFrame:
    """(h, tpl, leaf, n, template) of every line; texts: h, text."""
    line = F.col("line")
    # Most lines have neither digits nor white space but single spaces: byte functions are enough for them.
    shape = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[0-9\t\x0B\x0C\r]")
    special = F.col("special")
    template = F.when(special, _template(line)).otherwise(line)
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    n = F.when(special, F.regexp_count(template, F.lit(TOKEN))).when(line == "", 0).otherwise(spaces + 1)
    lead = F.when(special, F.array_join(F.slice(_tokens(template), 1, depth), " ")).otherwise(F.substring_index(line, " ", depth))
    return texts.select("h", F.explode(F.split("text", "\n")).alias("line")).withColumn("special", shape).select(
        "h", template.alias("template"), n.alias("n"), F.xxhash64(n, lead).alias("leaf"), F.xxhash64(template).alias("tpl")
    )


def near_copies(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(h, g): the group of every text that is a near-copy of another; held: templates of texts."""

    def near(c: Column, u: Column) -> Column:
        """c of u runs are common; s of them, at most c, are in the shared lines."""
        s = F.least("s", c)
        return (c * 10 >= u * 8) | ((c - s) * 10 >= (u - s) * 4)

    again = materialize(held.groupBy("tpl").count().where("count > 1").select("tpl"), "again", shrink=16)
    shared = materialize(held.join(_few(again), "tpl", "left_semi").select("h", "tpl", "n"), "shared", shrink=4)
    sharing = shared.select("h").distinct()
    sizes = materialize(held.join(_few(sharing), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("size")), "sizes", shrink=16)
    sized = shared.join(_few(sizes), "h")
    least = materialize(sized.groupBy("tpl").agg(F.min(F.struct("size", "h")).alias("least")).select("tpl", "least.size", "least.h"), "least", shrink=16)
    pairs = materialize(
        sized.join(_few(least.toDF("tpl", "b", "rep")), "tpl")
        .where(F.col("h") != F.col("rep"))
        .groupBy("h", "rep", "size", "b")
        .agg(F.sum(F.greatest(F.col("n") - 3, F.lit(0))).alias("s"), F.sum("n").alias("words"))
        .where(F.col("words") * 4 >= F.col("size"))
        .select("h", "rep", "s"),
        "pairs", shrink=16,
    )
    for t in (again, shared, sizes, least):
        release(t)
    ids = materialize(pairs.select("h").union(pairs.select("rep")).distinct(), "ids", shrink=16)
    # Equal texts meet before their runs are made.
    once = texts.join(_few(ids), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    words = once.select("h", _tokens(_template(F.col("text"))).alias("w"))
    starts = F.slice("w", F.lit(1), F.greatest(F.size("w") - 3, F.lit(0)))
    fours = F.array_distinct(F.transform(starts, lambda x, i: F.hash(x, F.get("w", i + 1), F.get("w", i + 2), F.get("w", i + 3))))
    grams = materialize(words.select("h", fours.alias("grams")), "grams")
    a, b = F.size("grams"), F.size("others")
    both = (
        pairs.join(grams, "h")
        .join(grams.select(F.col("h").alias("rep"), F.col("grams").alias("others")), "rep")
        # Necessary for a near-copy: the smaller set has all that is common.
        .where(near(F.least(a, b), F.greatest(a, b)))
        .select("h", "rep", "s", a.alias("a"), b.alias("b"), F.size(F.array_intersect("grams", "others")).alias("c"))
        .withColumn("u", F.col("a") + F.col("b") - F.col("c"))
    )
    links = materialize(both.where(near(F.col("c"), F.col("u"))).select(F.col("h").alias("a"), F.col("rep").alias("b")), "links", shrink=16)
    for t in (pairs, ids, grams):
        release(t)
    out = materialize(components(links).select(F.col("node").alias("h"), F.col("component").alias("g")), "copies", shrink=16)
    release(links)
    return out


def _families(texts: DataFrame, held: DataFrame, own: DataFrame, depth: int, min_docs: int, min_tokens: int, agree: float) -> DataFrame:
    """tpl of the lines whose generalised template recurs; own: held with near-copies as one text."""
    leaves = materialize(
        own.groupBy("leaf").agg(F.count("*").alias("docs"), F.min("tpl").alias("a"), F.max("tpl").alias("b"))
        .where((F.col("docs") >= min_docs) & (F.col("a") < F.col("b")))
        .select("leaf"),
        "leaves", shrink=16,
    )
    spread = own.join(_few(leaves), "leaf", "left_semi").groupBy("leaf").agg(F.countDistinct("h").alias("texts"))
    wide = materialize(spread.where(F.col("texts") >= min_docs).select("leaf"), "leaves", shrink=16)
    members = materialize(own.join(_few(wide), "leaf", "left_semi").select("h", "leaf", "tpl"), "members", shrink=4)
    # A template's text is fetched from one of the texts that have it.
    source = held.join(_few(wide), "leaf", "left_semi").groupBy("tpl").agg(F.min("h").alias("h")).select("h").distinct()
    shown = (
        _lines(texts.join(_few(materialize(source, "source", shrink=16)), "h", "left_semi"), depth)
        .where(F.col("n") >= min_tokens)
        .join(_few(wide), "leaf", "left_semi")
        .groupBy("leaf", "tpl", "n")
        .agg(F.min("template").alias("template"))
    )
    times = members.groupBy("leaf", "tpl").agg(F.count("*").alias("times"))
    places = materialize(
        shown.join(times, ["leaf", "tpl"])
        .select("leaf", "tpl", "n", "times", F.posexplode(_tokens(F.col("template"))).alias("pos", "token"))
        .select("leaf", "tpl", "n", "times", F.xxhash64("pos", "token").alias("place")),
        "places",
    )
    firm = places.groupBy("leaf", "place").agg(F.sum("times").alias("times")).where(F.col("times") >= min_docs).select("leaf", "place")
    # A generalised template is the set of places that stay.
    general = (
        places.join(firm, ["leaf", "place"])
        .groupBy("leaf", "tpl", "n")
        .agg(F.count("*").alias("fixed"), F.bit_xor("place").alias("general"))
        .where(F.col("fixed") >= agree * F.col("n"))
    )
    of_member = members.join(general.select("leaf", "tpl", "general"), ["leaf", "tpl"])
    often = of_member.groupBy("leaf", "general").agg(F.countDistinct("h").alias("texts")).where(F.col("texts") >= min_docs)
    out = materialize(general.join(often, ["leaf", "general"]).select("tpl").distinct(), "families", shrink=16)
    for t in (leaves, wide, members, places):
        release(t)
    return out


def recurring_templates(
    texts: DataFrame, depth: int = 3, min_docs: int = 5, min_tokens: int = 3, long_tokens: int = 50, agree: float = 0.7
) -> DataFrame:
    """(h, tpl): the dropped templates that each text has, from texts: h, text."""
    held = materialize(
        _lines(texts, depth).where(F.col("n") >= min_tokens).groupBy("h", "leaf", "tpl").agg(F.max("n").alias("n")), "held"
    )
    forget_shuffles(texts.sparkSession)
    found = near_copies(texts, held)
    copies = _few(found)
    own = materialize(
        held.join(copies, "h", "left_anti").unionByName(
            held.join(copies, "h").groupBy(F.col("g").alias("h"), "leaf", "tpl").agg(F.max("n").alias("n"))
        ),
        "own",
    )
    plain = (
        own.groupBy("tpl").agg(F.count("*").alias("docs"), F.max("n").alias("n"))
        .where((F.col("docs") >= min_docs) | ((F.col("n") >= long_tokens) & (F.col("docs") > 1)))
        .select("tpl")
    )
    families = _families(texts, held, own, depth, min_docs, min_tokens, agree)
    dropped = materialize(plain.unionByName(families).distinct(), "dropped", shrink=16)
    gone = materialize(held.select("h", "tpl").join(_few(dropped), "tpl", "left_semi"), "gone", shrink=4)
    for t in (held, found, own, families, dropped):
        release(t)
    forget_shuffles(texts.sparkSession)
    return gone


def _cleaned(docs: DataFrame, text_col: str, options: dict) -> DataFrame:
    """docs with columns c0, c1, ..., the text without its recurring lines, and n_lines and n_dropped appended."""
    n = len(docs.columns)
    at = docs.columns.index(text_col)
    text = F.col(f"c{at}")
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    forget_shuffles(docs.sparkSession)
    gone = recurring_templates(plain.where(text.isNotNull()).select(_hash(text).alias("h"), text.alias("text")), **options)
    per_text = gone.groupBy("h").agg(F.collect_set("tpl").alias("gone"))
    if gone.limit(BROADCAST_NUMBERS // 2 + 1).count() <= BROADCAST_NUMBERS // 2:
        per_text = F.broadcast(per_text)
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(_template(x))))
    # Texts without a dropped line, nearly all, are not split.
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        plain.withColumn("h", F.when(text.isNotNull(), _hash(text)))
        .join(per_text, "h", "left")
        .select(*[f"c{i}" for i in range(n)], F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), kept).alias("kept"))
        .select(
            *[F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text).alias(f"c{i}") if i == at else F.col(f"c{i}") for i in range(n)],
            "n_lines",
            F.when(F.col("kept").isNotNull(), F.col("n_lines") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
        )
    )


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the recurring lines taken out of text_col, and n_lines and n_dropped appended."""
    return _cleaned(docs, text_col, options).toDF(*docs.columns, "n_lines", "n_dropped")


def without_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the recurring lines taken out of text_col, with the columns of docs only."""
    return _cleaned(docs, text_col, options).drop("n_lines", "n_dropped").toDF(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    return drop_recurring_lines(docs.select("doc_id", "text"))


#: {docs} is a relation with doc_id and text; the result has every document with its text without recurring lines. The
#: members are recursive: line_reach follows the links of near-copies.
SQL = """
line_texts AS (SELECT text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM (SELECT DISTINCT text FROM {docs} WHERE text IS NOT NULL)),
line_rows AS (SELECT h, regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g') AS tpl
  FROM (SELECT h, unnest(string_split(text, chr(10))) AS line FROM line_texts)),
line_held AS MATERIALIZED (SELECT h, tpl, any_value(toks) AS toks, len(any_value(toks)) AS n,
    array_to_string([len(any_value(toks))::VARCHAR, any_value(toks)[1], any_value(toks)[2], any_value(toks)[3]], chr(10)) AS leaf
  FROM (SELECT h, tpl, regexp_extract_all(tpl, '[^\\x20\\x09-\\x0D]+') AS toks FROM line_rows) WHERE len(toks) >= 3 GROUP BY h, tpl),
line_sizes AS (SELECT h, sum(n) AS size FROM line_held GROUP BY h),
line_shared AS (SELECT h, tpl, n, size FROM line_held JOIN line_sizes USING (h) WHERE tpl IN (SELECT tpl FROM line_held GROUP BY tpl HAVING count(*) > 1)),
line_least AS (SELECT tpl, first(h ORDER BY size, h) AS rep FROM line_shared GROUP BY tpl),
line_pairs AS MATERIALIZED (SELECT h, rep, sum(greatest(n - 3, 0)) AS s FROM line_shared JOIN line_least USING (tpl) WHERE h <> rep
  GROUP BY h, rep, size HAVING 4 * sum(n) >= size),
line_runs AS MATERIALIZED (SELECT DISTINCT h, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] || chr(10) || w[i + 3] AS run
  FROM (SELECT h, w, unnest(generate_series(1, len(w) - 3)) AS i FROM (
    SELECT h, regexp_extract_all(regexp_replace(text, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM line_texts WHERE h IN (SELECT h FROM line_pairs UNION SELECT rep FROM line_pairs)))),
line_counts AS (SELECT h, count(*) AS a FROM line_runs GROUP BY h),
line_common AS (SELECT p.h, p.rep, count(*) AS c FROM line_pairs p JOIN line_runs x ON x.h = p.h JOIN line_runs y ON y.h = p.rep AND y.run = x.run GROUP BY p.h, p.rep),
line_links AS MATERIALIZED (SELECT h, rep FROM (SELECT p.h, p.rep, coalesce(c, 0) AS c, coalesce(x.a, 0) + coalesce(y.a, 0) - coalesce(c, 0) AS u, least(s, coalesce(c, 0)) AS s
    FROM line_pairs p LEFT JOIN line_common k ON k.h = p.h AND k.rep = p.rep LEFT JOIN line_counts x ON x.h = p.h LEFT JOIN line_counts y ON y.h = p.rep)
  WHERE c * 10 >= u * 8 OR (c - s) * 10 >= (u - s) * 4),
line_both AS (SELECT h AS a, rep AS b FROM line_links UNION SELECT rep, h FROM line_links),
line_reach AS (SELECT a AS h, a AS g FROM line_both UNION SELECT r.h, l.b FROM line_reach r JOIN line_both l ON l.a = r.g),
line_groups AS (SELECT h, min(g) AS g FROM line_reach GROUP BY h),
line_own AS MATERIALIZED (SELECT DISTINCT coalesce(g, h) AS h, tpl, toks, n, leaf FROM line_held LEFT JOIN line_groups USING (h)),
line_leaves AS (SELECT leaf FROM line_own GROUP BY leaf HAVING count(DISTINCT h) >= 5 AND min(tpl) < max(tpl)),
line_members AS (SELECT * FROM line_own WHERE leaf IN (SELECT leaf FROM line_leaves)),
line_places AS (SELECT leaf, tpl, n, times, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
  FROM (SELECT leaf, tpl, n, any_value(toks) AS toks, count(*) AS times FROM line_members GROUP BY leaf, tpl, n)),
line_fixed AS (SELECT leaf, pos, token FROM line_places GROUP BY leaf, pos, token HAVING sum(times) >= 5),
line_general AS (SELECT leaf, tpl, string_agg(pos || ' ' || token, chr(10) ORDER BY pos) AS general FROM line_places JOIN line_fixed USING (leaf, pos, token)
  GROUP BY leaf, tpl, n HAVING count(*) >= 0.7 * n),
line_often AS (SELECT leaf, general FROM line_members JOIN line_general USING (leaf, tpl) GROUP BY leaf, general HAVING count(DISTINCT h) >= 5),
line_gone AS (SELECT tpl FROM line_own GROUP BY tpl HAVING count(*) >= 5 OR (any_value(n) >= 50 AND count(*) > 1)
  UNION SELECT tpl FROM line_general JOIN line_often USING (leaf, general)),
line_kept AS (SELECT text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean
  FROM (SELECT text, pos, line, regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g') IN (SELECT tpl FROM line_gone) AS gone
    FROM (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM line_texts))
  GROUP BY text)
"""
