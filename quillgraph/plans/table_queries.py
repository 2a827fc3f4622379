"""Text, retrieval, build, capability, cluster and evaluation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars, text, vectors
from quillgraph.functions.wordlists import CLASS_KEYWORDS, DOMAIN_TERMS, PLAIN_TERMS, STOP_WORDS
from quillgraph.operators import capability, cluster, etl, evaluate, graph, retrieval
from quillgraph.plans.graph_queries import brand_links
from quillgraph.plans.registry import query
from quillgraph.plans.views import CALLS_SQL, EDGES_SQL, NODES_SQL, call_codes, calls, code_of, edges, nodes, supplier_codes, supplier_of, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
# DuckDB: distinct tokens, and distinct padded trigrams of words.
TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"
_TRI = """list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'),
  lambda w: list_transform(range(1, (length(w) + 2)::INT), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"""


def _key(c: str):
    return F.col(c).cast("string")


@query("fn1_entity_id", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'fn' WHEN p_size < 20 THEN 'var' WHEN p_size < 30 THEN 'cls' WHEN p_size < 40 THEN 'file' ELSE 'sym' END || ':' ||
  substr(sha256('(''' || p_name || ''', ''' || p_partkey || ''')'), 1, 7) AS entity_id FROM part""")
def fn1(spark, sf):
    size = F.col("p_size")
    kind = F.when(size < 10, "define").when(size < 20, "variable").when(size < 30, "struct").when(size < 40, "file").otherwise("enum")
    return table(spark, sf, "part").select("p_partkey", scalars.entity_id(kind, F.col("p_name"), _key("p_partkey")).alias("entity_id"))


@query("fn2_unique_ids", "SELECT p_partkey, 'p:' || p_partkey AS id FROM part")
def fn2(spark, sf):
    return etl.check_unique(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p:"), _key("p_partkey")).alias("id")), "id")


@query("fn_token_jaccard", f"""WITH d AS (SELECT doc_id, list_filter({TOKENS.format("coalesce(text, '')")}, lambda x: x NOT IN ({_STOP})) AS t FROM documents),
  q AS (SELECT list_filter({TOKENS.format("text")}, lambda x: x NOT IN ({_STOP})) AS q FROM benchmark WHERE item_id = 0)
  SELECT doc_id, len(t) AS n_tokens, round(CASE WHEN len(t) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE END, 6) AS jaccard,
  round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(t, q)) / len(q)::DOUBLE END, 6) AS coverage FROM d, q""")
def fn_tokens(spark, sf):
    item = table(spark, sf, "benchmark").where("item_id = 0").select(text.tokens(F.col("text")).alias("q"))
    rows = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).join(F.broadcast(item))  # one row
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.round(text.token_jaccard(F.col("t"), F.col("q")), 6).alias("jaccard"), F.round(text.query_coverage(F.col("q"), F.col("t")), 6).alias("coverage"))


@query("fn6_shape_rank", "SELECT o_orderkey, round(least(ln(1 + o_totalprice) / ln(1 + 300000.0), 1.0), 6) AS shaped FROM orders")
def fn6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(scalars.shape_rank(F.col("o_totalprice"), 300000.0), 6).alias("shaped"))


@query("fn7_symbol_like", "SELECT p_partkey, trim(p_name) <> '' AND (contains(trim(p_name), '(') OR NOT contains(trim(p_name), ' ')) AS symbol_like FROM part")
def fn7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.is_symbol_like(F.col("p_name")).alias("symbol_like"))


@query("fn8_scope_split", r"""SELECT s_suppkey, trim(regexp_extract(q, '(?s)^(.*)::(.*)$', 1)) AS scope, trim(regexp_extract(q, '(?s)^(.*)::(.*)$', 2)) AS bare
  FROM (SELECT s_suppkey, 'a::' || s_nationkey || ' :: ' || s_name AS q FROM supplier)""")
def fn8(spark, sf):
    q = F.concat(F.lit("a::"), _key("s_nationkey"), F.lit(" :: "), F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", scalars.scope_split(q).alias("s")).select("s_suppkey", "s.scope", "s.bare")


@query("fn9_searchable", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand || '::' || p_name || ' int ' || p_name || '(char *x, ' || p_type || ' &y);'), '[*&(),;]', '', 'g') AS searchable FROM part")
def fn9(spark, sf):
    sig = F.concat(F.lit("int "), "p_name", F.lit("(char *x, "), "p_type", F.lit(" &y);"))
    return table(spark, sf, "part").select("p_partkey", scalars.symbol_searchable(F.col("p_name"), F.concat_ws("::", "p_brand", "p_name"), sig).alias("searchable"))


@query("fn10_doc_embed_text", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'BRIEF: ' || p_name || chr(10) ELSE '' END || 'DETAILS: ' || p_type || chr(10) || 'PARAMS: ' || p_brand || ': ' || p_size || chr(10) || 'RATIONALE: ' || p_brand AS t FROM part""")
def fn10(spark, sf):
    none = F.lit(None).cast("string")
    brief = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("")
    params = F.create_map("p_brand", _key("p_size"))
    return table(spark, sf, "part").select("p_partkey", scalars.doc_embed_text(brief, F.col("p_type"), params, none, none, F.col("p_brand"), F.col("p_name")).alias("t"))


@query("fn11_symbol_embed_text", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'void ' || p_brand || '::' || p_name || '(' || p_name || ')' ELSE p_brand || '::' || p_name END AS t FROM part""")
def fn11(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "function").otherwise("class")
    sig = F.concat(F.lit("void "), "p_name", F.lit("("), "p_name", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", scalars.symbol_embed_text(kind, F.col("p_name"), F.concat_ws("::", "p_brand", "p_name"), sig).alias("t"))


@query("fn13_entry_points", """SELECT c_custkey, name, name LIKE 'do\\_%' ESCAPE '\\' OR name LIKE 'spell\\_%' ESCAPE '\\' AS is_entry, CASE WHEN name LIKE 'do\\_%' ESCAPE '\\' THEN 'do_' WHEN name LIKE 'spell\\_%' ESCAPE '\\' THEN 'spell_' END AS entry_type,
  CASE WHEN name LIKE 'do\\_%' ESCAPE '\\' THEN 'command' WHEN name LIKE 'spell\\_%' ESCAPE '\\' THEN 'spell' END AS entry_word FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'do_' WHEN 1 THEN 'spell_' ELSE 'get_' END || c_custkey AS name FROM customer)""")
def fn13(spark, sf):
    k = F.col("c_nationkey") % 3
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.when(k == 0, "do_").when(k == 1, "spell_").otherwise("get_"), _key("c_custkey")).alias("name"))
    n = F.col("name")
    return rows.select("c_custkey", "name", scalars.is_entry_point(F.lit("function"), n).alias("is_entry"), scalars.entry_type(n).alias("entry_type"), scalars.entry_type(n, True).alias("entry_word"))


@query("fn15_bare_name", "SELECT s_suppkey, 'do_' || s_suppkey AS short_name, 'Combat::do_' || s_suppkey AS bare FROM supplier")
def fn15(spark, sf):
    sig = F.concat(F.lit("static void Combat::do_"), _key("s_suppkey"), F.lit("(int x)"))
    return table(spark, sf, "supplier").select("s_suppkey", scalars.entry_point_name(sig).alias("short_name"), scalars.bare_name(sig).alias("bare"))


_DOMAIN = ", ".join(f"'{t}'" for t in DOMAIN_TERMS)


@query("fn16_specificity", f"""SELECT doc_id, length(text) AS notes_length, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(least(length(text) / 500.0::DOUBLE, 1.0) * (0.5 + 0.5 * len(list_intersect(w, [{_DOMAIN}])) / len(w)), 4) END AS specificity
  FROM (SELECT doc_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)""")
def fn16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("notes_length"), scalars.rationale_specificity(F.col("text")).alias("specificity"))


_PLAIN = ", ".join(f"'{t}'" for t in PLAIN_TERMS)


@query("fn18_name_terms", f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(regexp_replace(replace(lower(p_type), ' ', '-') || 'LoadUserName.cc', '([^A-Z])([A-Z])', '\\1_\\2', 'g')), '[_\\s\\-.]')) AS term FROM part)
  WHERE length(term) > 2 AND term NOT IN ({_PLAIN}) GROUP BY term""")
def fn18(spark, sf):
    name = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("LoadUserName.cc"))
    return table(spark, sf, "part").select(F.explode(scalars.name_terms(name)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("fn19_clean_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '(?s)```.*?```', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
def fn19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(scalars.clean_text(F.col("text"))).alias("h"))


@query("fn24_normalise", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def fn24(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(vectors.l2_normalise("embedding")[0], 6).alias("first"))


@query("fn26_utility_score", "SELECT s_suppkey, round(pow((s_acctbal + 1000) / 12000, 2.0) * pow((s_nationkey + 1) / 25.0::DOUBLE, 0.5), 6) AS score FROM supplier")
def fn26(spark, sf):
    parts = {"a": ((F.col("s_acctbal") + 1000) / 12000, 2.0), "b": ((F.col("s_nationkey") + 1) / 25.0, 0.5)}
    return table(spark, sf, "supplier").select("s_suppkey", F.round(scalars.utility_score(parts), 6).alias("score"))


@query("r5_trigram_topk", f"""SELECT p_partkey, round(s, 6) AS score FROM (SELECT p_partkey, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE AS s
  FROM (SELECT p_partkey, {_TRI.format("p_name")} AS t, {_TRI.format("'blue steel part'")} AS q FROM part)) WHERE s >= 0.2 ORDER BY s DESC, p_partkey LIMIT 100""")
def r5(spark, sf):
    return retrieval.trigram_channel(table(spark, sf, "part"), "p_partkey", "p_name", "blue steel part").withColumn("score", F.round("score", 6))


_POST = """post AS (SELECT doc_id, lexeme, max(w) AS weight FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS lexeme, 0.4 AS w FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9_]+')), 1.0 FROM documents) GROUP BY ALL)"""


def _postings(spark, sf):
    return text.postings(table(spark, sf, "documents"), "doc_id", {"text": 0.4, "source": 1.0})


@query("r1_keyword_topk", f"""WITH {_POST} SELECT doc_id, round(sum(weight), 6)::DOUBLE AS score FROM post WHERE lexeme IN ('the', 'and', 'src0') GROUP BY doc_id HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 100""")
def r1(spark, sf):
    return retrieval.keyword_channel(_postings(spark, sf), "doc_id", ["the", "and", "src0"]).withColumn("score", F.round("score", 6))


_VEC = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _probe(spark, sf, vec_id=0):
    row = table(spark, sf, "embeddings").where(f"vec_id = {vec_id}").select("embedding").first()
    return [float(x) for x in row[0]]


_TWO = f"""sem AS (SELECT e.vec_id AS id, {_VEC} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, id LIMIT 100),
  {_POST}, kw AS (SELECT doc_id AS id, sum(weight)::DOUBLE AS s FROM post WHERE lexeme IN ('the', 'of') GROUP BY doc_id HAVING count(*) = 2 ORDER BY s DESC, id LIMIT 100),
  ex AS (SELECT doc_id AS id FROM documents WHERE source = 'src7'),
  merged AS (SELECT id, max(e) AS exact, max(a) AS doc_semantic, max(b) AS doc_keyword FROM (SELECT id, 1.0 AS e, 0.0 AS a, 0.0 AS b FROM ex UNION ALL SELECT id, 0, s, 0 FROM sem UNION ALL SELECT id, 0, 0, s FROM kw) GROUP BY id)"""


def _merged(spark, sf):
    docs = table(spark, sf, "documents")
    channels = {
        "exact": docs.where("source = 'src7'").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score")),
        "doc_semantic": retrieval.semantic_channel(table(spark, sf, "embeddings"), "vec_id", "embedding", _probe(spark, sf)).withColumnRenamed("vec_id", "id"),
        "doc_keyword": retrieval.keyword_channel(_postings(spark, sf), "doc_id", ["the", "of"]).withColumnRenamed("doc_id", "id"),
    }
    merged = retrieval.merge_channels(channels, "id")
    return merged.withColumn("doc_keyword_shaped", scalars.shape_rank(F.col("doc_keyword"), 2.0))


@query("r7_merge_floor", f"""WITH {_TWO} SELECT id, exact::DOUBLE AS exact, round(greatest(doc_semantic, 0), 6)::DOUBLE AS doc_semantic, round(least(ln(1 + doc_keyword) / ln(3.0), 1.0), 6) AS shaped FROM merged
  WHERE exact > 0 OR doc_semantic >= 0.3 OR least(ln(1 + doc_keyword) / ln(3.0), 1.0) >= 0.05""")
def r7(spark, sf):
    rows = retrieval.floor_filter(_merged(spark, sf))
    return rows.select("id", "exact", F.round(F.greatest("doc_semantic", F.lit(0.0)), 6).alias("doc_semantic"), F.round("doc_keyword_shaped", 6).alias("shaped"))


_SCORE = """(-1.25 + 0.65 * len(list_intersect({q}, {d})) + CASE WHEN contains(lower({dt}), lower({qt})) THEN 1.4 + CASE WHEN contains({qt}, '::') THEN 0.4 ELSE 0 END ELSE 0 END
  + CASE WHEN len(list_intersect({q}, {d})) = 0 THEN -0.35 ELSE 0 END)"""


def _score_sql(qt: str, dt: str) -> str:
    return _SCORE.format(q=TOKENS.format(qt), d=TOKENS.format(dt), qt=qt, dt=dt)


@query("r13_arbitrate", f"""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS brief, p_size < 5 AS exact, {_score_sql("'STEEL'", "p_type")}::DOUBLE AS cd, {_score_sql("'STEEL'", "p_name")}::DOUBLE AS cs FROM part),
  e AS (SELECT *, CASE WHEN cd > cs AND coalesce(brief, '') = '' THEN cd - 3 ELSE cd END AS d FROM s),
  w AS (SELECT *, CASE WHEN d > cs + 2 THEN 'doc' ELSE 'symbol' END AS winning_view, CASE WHEN d > cs + 2 THEN d ELSE cs END AS winning_score, CASE WHEN d > cs + 2 THEN cs ELSE d END AS losing_score FROM e)
  SELECT p_partkey, winning_view, round(winning_score, 6) AS winning_score, round(losing_score, 6) AS losing_score, CASE WHEN exact AND winning_score >= 0 THEN 1 ELSE 0 END AS tier FROM w
  WHERE exact OR winning_score >= 0.5 OR p_partkey % 10 > 0 ORDER BY tier DESC, winning_score DESC, losing_score DESC, p_partkey LIMIT 200""")
def r13(spark, sf):
    q = F.lit("STEEL")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("brief"), (F.col("p_size") < 5).cast("double").alias("exact"),
        retrieval.deterministic_score(q, F.col("p_type")).alias("ce_doc"), retrieval.deterministic_score(q, F.col("p_name")).alias("ce_symbol"),
        (F.col("p_partkey") % 10).cast("double").alias("signal"),
    )
    done = retrieval.final_order(retrieval.rerank_floor(retrieval.arbitrate(rows, scalars.is_symbol_like(q)), ["signal"]), scalars.is_symbol_like(q), "p_partkey", 200)
    return done.select("p_partkey", "winning_view", F.round("winning_score", 6).alias("winning_score"), F.round("losing_score", 6).alias("losing_score"), "tier")


@query("r16_usage_search", f"""WITH u AS (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant'),
  kw AS (SELECT conv_id, turn, len(list_intersect({TOKENS.format("coalesce(text, '')")}, ['the', 'and', 'of']))::DOUBLE AS s FROM u), kt AS (SELECT * FROM kw WHERE s > 0 ORDER BY s DESC, conv_id, turn LIMIT 100),
  kn AS (SELECT conv_id, turn, s / (SELECT max(s) FROM kt) AS kw FROM kt),
  sem AS (SELECT conv_id, turn, length(text) / 4000.0::DOUBLE AS s FROM u WHERE text IS NOT NULL ORDER BY s DESC, conv_id, turn LIMIT 100),
  b AS (SELECT coalesce(kn.conv_id, sem.conv_id) AS conv_id, coalesce(kn.turn, sem.turn) AS turn, coalesce(kw, 0) * 0.4 + coalesce(s, 0) * 0.6 AS score FROM kn FULL JOIN sem ON kn.conv_id = sem.conv_id AND kn.turn = sem.turn),
  c AS (SELECT conv_id, max(score) AS callee_score FROM b GROUP BY conv_id ORDER BY callee_score DESC, conv_id LIMIT 20)
  SELECT conv_id, turn, round(score, 6) AS score, rank, round(callee_score, 6) AS callee_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM b) JOIN c USING (conv_id) WHERE rank <= 3 AND callee_score >= 0.2""")
def r16(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'assistant'")
    terms = F.array(F.lit("the"), F.lit("and"), F.lit("of"))
    kw = u.select("conv_id", "turn", F.size(F.array_intersect(text.tokens(F.col("text"), False), terms)).cast("double").alias("score")).where("score > 0")
    kw = kw.orderBy(F.desc("score"), "conv_id", "turn").limit(100)
    sem = u.where("text is not null").select("conv_id", "turn", (F.length("text") / 4000.0).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(100)
    best = retrieval.best_usages(retrieval.usage_scores(kw, sem, ["conv_id", "turn"]), "conv_id", ["turn"], 20)
    return best.select("conv_id", "turn", F.round("score", 6).alias("score"), "rank", F.round("callee_score", 6).alias("callee_score"))


@query("r18_resolve_prefix", """SELECT 'c:' || c_custkey AS entity_id, c_name AS name, 'prefix' AS match_type, 'ambiguous' AS status FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY length(c_name), entity_id LIMIT 20""")
def r18(spark, sf):
    ents = nodes(spark, sf).select(F.col("node").alias("entity_id"), "name", F.lit("").alias("signature"), F.lit(0).alias("fan_in"))
    return retrieval.resolve(ents, "Customer#00000001")


_CENTRES = """cent AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, sum(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x,
  generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL) GROUP BY label)"""


@query("r21_classify_argmax", f"""WITH {_CENTRES} SELECT vec_id, CASE WHEN s >= 0.4 THEN label::VARCHAR ELSE 'uncategorized' END AS grp, round(s, 6) AS similarity FROM (
  SELECT vec_id, cent.label, list_cosine_similarity(embedding::DOUBLE[], c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], c) DESC, cent.label::VARCHAR) AS r FROM embeddings, cent) WHERE r = 1""")
def r21(spark, sf):
    rows = table(spark, sf, "embeddings")
    centres = cluster.group_sums(rows, "vec_id", "label", "embedding").select(_key("grp").alias("grp"), F.col("total").alias("centre"))
    return capability.classify(rows, centres, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("r20_probe_diagnostic", f"""WITH {_CENTRES} SELECT label AS grp, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most FROM (
  SELECT label, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings JOIN cent USING (label)) GROUP BY label""")
def r20(spark, sf):
    rows = table(spark, sf, "embeddings")
    centres = cluster.group_sums(rows, "vec_id", "label", "embedding").select("grp", F.col("total").alias("centre"))
    members = rows.select(F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return capability.probe_diagnostic(members, centres).select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


@query("r19_probe", f"""SELECT vec_id, round(sim, 6) AS sim, round(avoid_sim, 6) AS avoid_sim FROM (SELECT e.vec_id, {_VEC} AS sim, list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS avoid_sim
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q, (SELECT embedding FROM embeddings WHERE vec_id = 1) a) WHERE sim >= 0.1 AND NOT (avoid_sim > sim OR avoid_sim >= 0.2)""")
def r19(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return capability.probe(rows, _probe(spark, sf), _probe(spark, sf, 1), 0.1, 0.2, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"), F.round("avoid_sim", 6).alias("avoid_sim"))


@query("p9_fetch_in_order", "SELECT o_orderkey, ord FROM orders JOIN (VALUES (7, 0), (3, 1), (-1, 2), (5, 3)) t(k, ord) ON o_orderkey = k")
def p9(spark, sf):
    return etl.fetch_in_order(table(spark, sf, "orders").select("o_orderkey"), [7, 3, -1, 5], "o_orderkey")


@query("p3_like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%b_ue%'")
def p3(spark, sf):
    return table(spark, sf, "part").where(scalars.like_contains(F.col("p_name"), F.lit("b_ue"))).select("p_partkey", "p_name")


@query("j1_top_callers", """SELECT o_orderkey, o_custkey, coalesce(m, 0.0) AS best FROM orders LEFT JOIN (SELECT c_custkey, max(c_acctbal) AS m FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey) ON o_custkey = c_custkey
  ORDER BY best DESC, o_orderkey LIMIT 50""")
def j1(spark, sf):
    ents = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(_key("c_custkey").alias("signature"), F.col("c_acctbal").alias("fan_in"))
    uses = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("callee_id"), F.lit("").alias("caller_compound"), _key("o_custkey").alias("caller_sig"))
    return etl.top_callers(uses, ents, 50).select("o_orderkey", "o_custkey", F.col("caller_fan_in").alias("best"))


@query("j2_attach_documents", """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def j2(spark, sf):
    ents = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("compound"), _key("doc_id").alias("signature"), F.lit("n").alias("name"))
    docs = table(spark, sf, "labels").select(F.lit("x").alias("compound"), _key("doc_id").alias("signature"), F.lit("m").alias("name"), _key("quality").alias("brief"), F.lit("").alias("details"))
    return etl.attach_documents(ents, docs).select("doc_id", F.col("doc.brief").cast("int").alias("quality"))


@query("j4_dedupe_split", """SELECT text, doc_id, q FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY (quality IS NOT NULL) DESC, doc_id) AS r,
  coalesce(toxic, first_value(toxic IGNORE NULLS) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS q, max(quality IS NOT NULL) OVER (PARTITION BY text) AS ok
  FROM (SELECT md5(text) AS text, doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL)) WHERE r = 1 AND ok""")
def j4(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").join(table(spark, sf, "labels"), "doc_id", "left").select(F.md5("text").alias("text"), "doc_id", F.col("quality").isNotNull().alias("body"), F.col("toxic").alias("q"))
    good = rows.where("body").select("text").distinct()
    return etl.dedupe_declarations(rows.join(good, "text", "left_semi"), "text", "doc_id", "body", "q").select("text", "doc_id", "q")


@query("j5_rewrite_edges", f"""WITH {EDGES_SQL}, {NODES_SQL} SELECT DISTINCT md5(src) AS source_id, md5(dst) AS target_id, relationship FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)""")
def j5(spark, sf):
    ids = nodes(spark, sf).select("node", F.md5("node").alias("entity_id"))
    return etl.rewrite_edges(edges(spark, sf), ids)[0]


@query("j5_skipped_edges", f"""WITH {EDGES_SQL}, {NODES_SQL} SELECT src, dst, relationship FROM edges WHERE src NOT IN (SELECT node FROM nodes) OR dst NOT IN (SELECT node FROM nodes)""")
def j5b(spark, sf):
    ids = nodes(spark, sf).select("node", F.md5("node").alias("entity_id"))
    return etl.rewrite_edges(edges(spark, sf), ids)[1]


@query("j6_assign_by_name", """SELECT p_partkey, brand AS capability FROM part JOIN (SELECT p_name, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name) USING (p_name)""")
def j6(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("capability"), F.col("p_partkey").alias("ord"))
    return etl.assign_by_name(part.select("p_partkey", F.col("p_name").alias("name")), names).select("p_partkey", "capability")


@query("j9_full_union", """SELECT coalesce(c_custkey, k) AS key, CASE WHEN c_custkey IS NULL THEN 'new' WHEN k IS NULL THEN 'dropped' ELSE 'preserved' END AS change FROM customer FULL JOIN (SELECT p_partkey + 500 AS k FROM part) ON c_custkey = k""")
def j9(spark, sf):
    old = table(spark, sf, "customer").select(F.lit("c").alias("compound"), _key("c_custkey").alias("signature"), _key("c_custkey").alias("name"))
    moved = (F.col("p_partkey") + 500).cast("string")
    new = table(spark, sf, "part").select(F.lit("c").alias("compound"), moved.alias("signature"), F.lit("-").alias("name"), F.lit(True).alias("has_body"), moved.alias("entity_id"))
    return etl.signature_map(old, new).select(F.col("signature").cast("long").alias("key"), "change")


@query("j12_mirror_missing", f"""WITH {CALLS_SQL} SELECT src, dst FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls m WHERE m.src = c.dst AND m.dst = c.src)""")
def j12(spark, sf):
    e = calls(spark, sf)
    return etl.mirror_missing(e, e)[0]


@query("ag3_stats", f"""WITH {EDGES_SQL}, {NODES_SQL} SELECT 'total' AS section, 'entities' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY relationship""")
def ag3(spark, sf):
    return etl.statistics(nodes(spark, sf), edges(spark, sf))


@query("ag4_p99_ceiling", "SELECT round(greatest(coalesce(quantile_cont(l_extendedprice, 0.99), 1.0), 0.01), 6) AS ceiling FROM lineitem")
def ag4(spark, sf):
    return etl.rank_ceiling(table(spark, sf, "lineitem"), "l_extendedprice").select(F.round("ceiling", 6).alias("ceiling"))


@query("ag5_explode_usages", """SELECT event_id AS callee_id, 'c' || (user_id % 7) AS caller_compound, event_type || ', ' || user_id AS caller_sig, props AS description FROM events""")
def ag5(spark, sf):
    k = F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"), F.lit(", "), F.col("event_type"), F.lit(", "), _key("user_id"))
    return etl.explode_usages(table(spark, sf, "events").select("event_id", F.create_map(k, F.col("props")).alias("usages")), "event_id")


_CAPS = f"""{CALLS_SQL}, {NODES_SQL}, raw AS (SELECT a.capability AS source_cap, b.capability AS target_cap, count(*) AS call_count FROM calls JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node
  WHERE a.capability <> b.capability GROUP BY ALL HAVING count(*) >= 3)"""
_KINDS = "domain policy projection infrastructure utility".split()
_TYPE_SQL = "CASE hash_of % 5 WHEN 0 THEN 'domain' WHEN 1 THEN 'policy' WHEN 2 THEN 'projection' WHEN 3 THEN 'infrastructure' ELSE 'utility' END"


def _members(spark, sf):
    return nodes(spark, sf).select("node", "capability")


def _types(spark, sf):
    """A type for each capability by the length of its name."""
    k = F.length("capability") % 5
    kind = F.when(k == 0, _KINDS[0]).when(k == 1, _KINDS[1]).when(k == 2, _KINDS[2]).when(k == 3, _KINDS[3]).otherwise(_KINDS[4])
    return _members(spark, sf).where("capability is not null").select("capability").distinct().withColumn("type", kind)


_TYPES = f"types AS (SELECT capability, {_TYPE_SQL} AS type FROM (SELECT DISTINCT capability, length(capability) AS hash_of FROM nodes WHERE capability IS NOT NULL))"
_EDGE = "CASE b.type WHEN 'domain' THEN 'requires_core' WHEN 'policy' THEN 'requires_policy' WHEN 'projection' THEN 'requires_projection' WHEN 'infrastructure' THEN 'requires_infrastructure' ELSE 'uses_utility' END"
_CAP_EDGES = f"{_CAPS}, {_TYPES}, ce AS (SELECT source_cap, target_cap, call_count, {_EDGE} AS edge_type, b.type <> 'utility' AS in_dag FROM raw JOIN types b ON target_cap = b.capability)"


def _cap_edges(spark, sf):
    e = capability.capability_edges(calls(spark, sf), _members(spark, sf), _types(spark, sf))
    return e.withColumn("in_dag", F.col("edge_type") != "uses_utility")


@query("ag6_cap_edges", f"WITH {_CAP_EDGES} SELECT source_cap, target_cap, call_count, edge_type FROM ce")
def ag6(spark, sf):
    return _cap_edges(spark, sf).drop("in_dag")


@query("ag11_tiers", f"""WITH {_CAP_EDGES} SELECT capability, type, coalesce(d, 0) AS dag_fan_in, coalesce(a, 0) AS all_fan_in, coalesce(o, 0) AS fan_out,
  CASE WHEN type = 'utility' THEN 0 WHEN coalesce(d, 0) >= 10 THEN 1 WHEN coalesce(d, 0) >= 3 THEN 2 WHEN coalesce(d, 0) = 0 THEN 4 ELSE 3 END AS tier FROM types
  LEFT JOIN (SELECT target_cap AS capability, count(*) FILTER (WHERE in_dag) AS d, count(*) AS a FROM ce GROUP BY target_cap) USING (capability) LEFT JOIN (SELECT source_cap AS capability, count(*) AS o FROM ce GROUP BY source_cap) USING (capability)""")
def ag11(spark, sf):
    return capability.fan_in(_cap_edges(spark, sf), _types(spark, sf)).withColumn("tier", capability.tier(F.col("type"), F.col("dag_fan_in")))


@query("ag13_bundling", f"""WITH {_CAP_EDGES} SELECT target_cap AS support_group, b.type AS support_type, string_agg(DISTINCT source_cap, ',' ORDER BY source_cap) AS domain_consumers FROM ce JOIN types b ON target_cap = b.capability JOIN types a ON source_cap = a.capability
  WHERE in_dag AND b.type IN ('policy', 'projection') AND a.type = 'domain' GROUP BY ALL HAVING count(DISTINCT source_cap) <= 2""")
def ag13(spark, sf):
    return capability.bundling(_cap_edges(spark, sf), _types(spark, sf))


@query("ag10_compare", f"""WITH {CALLS_SQL}, {NODES_SQL}, wanted AS (SELECT capability FROM (SELECT DISTINCT capability FROM nodes WHERE kind = 'supplier') ORDER BY capability LIMIT 2),
  called AS (SELECT DISTINCT dst, capability AS from_cap FROM calls JOIN nodes ON src = node WHERE capability IN (FROM wanted)),
  sets AS (SELECT dst AS node, count(*) AS k, string_agg(from_cap, ',' ORDER BY from_cap) AS capabilities FROM called GROUP BY dst),
  rows_ AS (SELECT CASE WHEN k >= 2 THEN 'shared' ELSE 'unique' END AS section, node, capabilities FROM sets UNION ALL
    SELECT 'bridge', node, string_agg(from_cap, ',' ORDER BY from_cap) || '>' || capability FROM called JOIN nodes ON dst = node WHERE from_cap <> capability AND capability IN (FROM wanted) GROUP BY node, capability)
  SELECT section, node, capabilities FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY node, capabilities) AS r FROM rows_) WHERE r <= 50""")
def ag10(spark, sf):
    n = nodes(spark, sf)
    wanted = [r[0] for r in n.where("kind = 'supplier'").select("capability").distinct().orderBy("capability").limit(2).collect()]
    return capability.compare(calls(spark, sf), n.select("node", "capability"), wanted)


@query("ag9_exercise_counts", f"""WITH RECURSIVE {CALLS_SQL}, {NODES_SQL}, walk AS (SELECT 's:' || s_suppkey AS seed, 's:' || s_suppkey AS node, 0 AS depth FROM supplier
  UNION SELECT seed, dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 5), least AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL)
  SELECT seed, capability, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS transitive FROM least JOIN nodes USING (node) WHERE depth > 0 AND capability IS NOT NULL GROUP BY ALL""")
def ag9(spark, sf):
    e = call_codes(spark, sf).withColumn("relationship", F.lit("calls"))
    # Nations and regions, which have no keys in calls, have no capability either.
    m = _members(spark, sf).where("capability is not null").select(code_of("node").alias("node"), "capability")
    return capability.exercise_counts(e, supplier_codes(spark, sf), m).withColumn("seed", supplier_of("seed"))


@query("ag7_entry_capabilities", f"""WITH {CALLS_SQL}, {NODES_SQL} SELECT src AS seed, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities FROM calls JOIN nodes ON dst = node WHERE src LIKE 'c:%' AND capability IS NOT NULL GROUP BY src""")
def ag7(spark, sf):
    reached = calls(spark, sf).where("src like 'c:%'").select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    return capability.entry_point_capabilities(reached, _members(spark, sf))[0]


@query("gr23_enablement", """WITH w AS (SELECT n_name AS capability, (n_regionkey)::INT AS wave FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)), need AS (SELECT c_custkey AS entry, n_name AS capability FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT o_custkey, 'uncategorized' FROM orders)
  SELECT entry, CASE WHEN count(*) FILTER (WHERE capability <> 'uncategorized' AND wave IS NULL) > 0 THEN (SELECT max(wave) + 1 FROM w) ELSE coalesce(max(wave), (SELECT min(wave) FROM w)) END AS wave FROM need LEFT JOIN w USING (capability) GROUP BY entry""")
def gr23(spark, sf):
    nation = table(spark, sf, "nation")
    waves = nation.join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("capability"), F.col("n_regionkey").alias("wave"))
    need = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entry"), F.col("n_name").alias("capability"))
    return capability.enablement(need.unionByName(table(spark, sf, "orders").select(F.col("o_custkey").alias("entry"), F.lit("uncategorized").alias("capability"))), waves)


@query("gr25_enabling_chunk", """SELECT entry, chunk, wave FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY wave DESC, chunk) AS r FROM (SELECT DISTINCT o_custkey AS entry, o_orderpriority AS chunk, length(o_orderpriority) AS wave FROM orders)) WHERE r = 1""")
def gr25(spark, sf):
    o = table(spark, sf, "orders")
    names = o.select(F.col("o_orderpriority").alias("chunk")).distinct()
    chunk_of = names.select(F.col("chunk").alias("capability"), "chunk")
    return capability.enabling_chunk(o.select(F.col("o_custkey").alias("entry"), F.col("o_orderpriority").alias("capability")), chunk_of, names.withColumn("wave", F.length("chunk")))


@query("ag14_warnings", """SELECT 'large_chunk' AS type, p_brand AS chunk FROM part GROUP BY p_brand HAVING count(*) > 60 UNION ALL SELECT 'orphan', p_brand FROM part GROUP BY p_brand HAVING max(p_size) < 0 OR p_brand LIKE '%5'""")
def ag14(spark, sf):
    chunks = table(spark, sf, "part").groupBy(F.col("p_brand").alias("chunk")).agg(F.count("*").alias("member_count")).withColumn("tier_name", F.lit("leaf"))
    links = chunks.where("chunk not like '%5'").select(F.col("chunk").alias("src"), F.lit("x").alias("dst"))
    waves = chunks.select(F.col("chunk").alias("node"), F.lit(0).alias("wave"))
    return capability.chunk_warnings(chunks, links, waves)


@query("j13_chunk_edges", f"""WITH {_CAP_EDGES} SELECT left(source_cap, 1) AS src, left(target_cap, 1) AS dst, sum(call_count)::BIGINT AS call_count, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM ce WHERE in_dag AND left(source_cap, 1) <> left(target_cap, 1) GROUP BY ALL""")
def j13(spark, sf):
    chunk_of = _types(spark, sf).select("capability", F.substring("capability", 1, 1).alias("chunk"))
    return capability.chunk_edges(_cap_edges(spark, sf), chunk_of)


@query("j10_registry", """SELECT p_brand AS chunk, n, upper(p_brand) AS mode, CASE WHEN n % 2 = 0 THEN 'p1' ELSE 'unscheduled' END AS phase, '' AS notes FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) WHERE n % 3 > 0""")
def j10(spark, sf):
    chunks = table(spark, sf, "part").groupBy(F.col("p_brand").alias("chunk")).agg(F.count("*").alias("n"))
    decided = chunks.select("chunk", F.when(F.col("n") % 3 > 0, F.upper("chunk")).alias("mode"), F.when(F.col("n") % 2 == 0, "p1").alias("phase"), F.lit(None).cast("string").alias("notes"))
    return capability.registry(chunks, decided)


_PAIRS = """sims AS (SELECT a.label AS grp, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS v, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("ag18_cohesion", f"""WITH {_PAIRS} SELECT grp, (SELECT count(*) FROM embeddings WHERE label = grp) AS n, round(avg(s), 6) AS mean, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM sims GROUP BY grp""")
def ag18(spark, sf):
    c = cluster.cohesion(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return c.select("grp", "n", F.round("mean", 6).alias("mean"), "least", "most", F.round("p25", 6).alias("p25"), F.round("p75", 6).alias("p75"))


@query("ag19_centroids", f"""WITH {_CENTRES} SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.c, y.c), 6) AS similarity FROM cent x JOIN cent y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) > -1""")
def ag19(spark, sf):
    return cluster.centroid_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", -1.0).withColumn("similarity", F.round("similarity", 6))


_PEERS = """peers AS (SELECT a.vec_id, a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)"""


@query("cl16_outliers", f"WITH {_PEERS} SELECT vec_id AS key, label AS grp, round(m, 6) AS mean, round(1 - m, 6) AS outlierness FROM peers WHERE m < 0.5")
def cl16(spark, sf):
    return cluster.outliers(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").select("key", "grp", F.round("mean", 6).alias("mean"), F.round("outlierness", 6).alias("outlierness"))


_REGROUP = f"""{_PEERS}, cross_ AS (SELECT a.vec_id, b.label AS other, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY ALL),
  best AS (SELECT vec_id, arg_max(other, s) AS best, max(s) AS s FROM cross_ GROUP BY vec_id), moves AS (SELECT p.vec_id AS key, p.label AS grp, best, s - m AS delta FROM peers p JOIN best USING (vec_id) WHERE s > m)"""


@query("cl17_regroup", f"WITH {_REGROUP} SELECT key, grp, best, round(delta, 6) AS delta, round(delta / (SELECT max(delta) FROM moves), 6) AS confidence FROM moves")
def cl17(spark, sf):
    r = cluster.regroup(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return r.select("key", "grp", "best", F.round("delta", 6).alias("delta"), F.round("confidence", 6).alias("confidence"))


@query("cl18_apply_moves", f"WITH {_REGROUP} SELECT vec_id AS key, coalesce(best, label) AS grp FROM embeddings LEFT JOIN (SELECT key, best FROM moves WHERE delta / (SELECT max(delta) FROM moves) > 0.7) ON vec_id = key")
def cl18(spark, sf):
    rows = table(spark, sf, "embeddings")
    return cluster.apply_moves(rows.select(F.col("vec_id").alias("key"), F.col("label").alias("grp")), cluster.regroup(rows, "vec_id", "label", "embedding"))


def _labelings(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("node"), F.col("lang").alias("cluster")), d.select(F.col("doc_id").alias("node"), F.col("source").alias("cluster"))


@query("cl11_jaccard", """SELECT lang AS a, source AS b, round(n / (la + sb - n)::DOUBLE, 6) AS jaccard FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT lang, count(*) AS la FROM documents GROUP BY lang) USING (lang) JOIN (SELECT source, count(*) AS sb FROM documents GROUP BY source) USING (source)""")
def cl11(spark, sf):
    return cluster.cluster_jaccard(*_labelings(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query("cl12_nmi", """WITH t AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n) AS total FROM t), a AS (SELECT lang, sum(n) AS ra FROM t GROUP BY lang), b AS (SELECT source, sum(n) AS cb FROM t GROUP BY source)
  SELECT round((SELECT sum(n / total * ln(total * n / (ra * cb))) FROM t JOIN a USING (lang) JOIN b USING (source) CROSS JOIN s) / (((SELECT -sum(ra / total * ln(ra / total)) FROM a, s) + (SELECT -sum(cb / total * ln(cb / total)) FROM b, s)) / 2), 6) AS nmi""")
def cl12(spark, sf):
    return cluster.normalised_mutual_information(*_labelings(spark, sf)).select(F.round("nmi", 6).alias("nmi"))


@query("ag17_modularity", f"""WITH {EDGES_SQL}, {NODES_SQL}, e AS (SELECT a.capability AS ca, b.capability AS cb, count(*)::DOUBLE AS w FROM (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM calls) JOIN nodes a ON x = a.node JOIN nodes b ON y = b.node GROUP BY ALL), m AS (SELECT sum(w) AS m FROM e),
  d AS (SELECT c, sum(w) AS deg FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY c), i AS (SELECT ca AS c, sum(w) AS ins FROM e WHERE ca = cb GROUP BY ca)
  SELECT round(sum(coalesce(ins, 0) / m - pow(deg / (2 * m), 2)), 6) AS modularity, round(sum(coalesce(ins, 0) / m), 6) AS coverage FROM d LEFT JOIN i USING (c) CROSS JOIN m""")
def ag17(spark, sf):
    e = graph.weighted_projection(calls(spark, sf).withColumn("relationship", F.lit("calls")), {"calls": 1.0}).withColumn("weight", F.lit(1.0))
    m = cluster.modularity(e, _members(spark, sf).where("capability is not null"))
    return m.select(F.round("modularity", 6).alias("modularity"), F.round("coverage", 6).alias("coverage"))


@query("ag16_cluster_sizes", "SELECT count(*) AS clusters, sum(n)::BIGINT AS nodes, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def ag16(spark, sf):
    return cluster.size_summary(_labelings(spark, sf)[1]).withColumn("mean", F.round("mean", 6))


@query("ag22_cluster_links", f"""WITH {CALLS_SQL}, {NODES_SQL} SELECT a.capability AS source, b.capability AS target, count(*) AS n FROM calls JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.capability <> b.capability GROUP BY ALL""")
def ag22(spark, sf):
    return cluster.cluster_links(calls(spark, sf), _members(spark, sf).withColumnRenamed("capability", "cluster"))


@query("ag22_interfaces", f"""WITH {CALLS_SQL}, {NODES_SQL}, f AS (SELECT src, dst, a.capability AS sc, b.capability AS dc FROM calls JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.capability <> b.capability)
  SELECT dc AS cluster, dst AS node, count(*) AS n, 'in' AS direction FROM f GROUP BY ALL UNION ALL SELECT sc, src, count(*), 'out' FROM f GROUP BY ALL""")
def ag22b(spark, sf):
    return cluster.interfaces(calls(spark, sf), _members(spark, sf).withColumnRenamed("capability", "cluster"))


@query("ag21_density", f"""WITH {CALLS_SQL}, {NODES_SQL}, s AS (SELECT capability AS cluster, count(*) AS n FROM nodes WHERE capability IS NOT NULL GROUP BY capability), e AS (SELECT a.capability AS cluster, count(*) AS e FROM calls JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.capability = b.capability GROUP BY ALL)
  SELECT cluster, round(CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1))::DOUBLE ELSE 0 END, 9) AS density FROM s LEFT JOIN e USING (cluster)""")
def ag21(spark, sf):
    m = _members(spark, sf).where("capability is not null").withColumnRenamed("capability", "cluster")
    return cluster.density(calls(spark, sf), m).withColumn("density", F.round("density", 9))


@query("cl2_utility_metrics", f"""WITH {CALLS_SQL}, {NODES_SQL}, i AS (SELECT dst AS node, count(*) AS fi, list_distinct(list(capability) FILTER (WHERE capability IS NOT NULL)) AS s FROM calls LEFT JOIN nodes ON src = node GROUP BY dst), o AS (SELECT src AS node, count(*) AS fo, list_distinct(list(capability) FILTER (WHERE capability IS NOT NULL)) AS t FROM calls LEFT JOIN nodes ON dst = node GROUP BY src),
  b AS (SELECT coalesce(i.node, o.node) AS node, coalesce(fi, 0) AS fi, coalesce(fo, 0) AS fo, coalesce(len(s), 0) + 1 AS ic, coalesce(len(t), 0) AS oc, coalesce(len(list_intersect(s, t)), 0) AS sh FROM i FULL JOIN o ON i.node = o.node)
  SELECT node, 'calls' AS relationship, round(fi / max(fi) OVER ()::DOUBLE, 6) AS fan_in, round(fo / max(fo) OVER ()::DOUBLE, 6) AS fan_out, round(ic / max(ic) OVER ()::DOUBLE, 6) AS in_clusters, round(oc / max(oc) OVER ()::DOUBLE, 6) AS out_clusters, round(sh / greatest(ic, oc)::DOUBLE, 6) AS overlap FROM b""")
def cl2(spark, sf):
    e = calls(spark, sf).withColumn("relationship", F.lit("calls"))
    m = cluster.utility_metrics(e, _members(spark, sf).withColumnRenamed("capability", "cluster"))
    return m.select("node", "relationship", *[F.round(c, 6).alias(c) for c in ("fan_in", "fan_out", "in_clusters", "out_clusters", "overlap")])


_CLASS_SQL = ", ".join(f"('{k}', {i}, '{t}')" for i, (k, ts) in enumerate(CLASS_KEYWORDS.items()) for t in ts)
_PAGE_TERMS = f"""terms AS (SELECT grp, term, count(*) AS n FROM (SELECT event_type AS grp, unnest(regexp_split_to_array(lower(event_type || '_user.file_' || (user_id % 5) || '-event tool'), '[_\\s\\-.]')) AS term FROM events) WHERE length(term) > 2 AND term NOT IN ({_PLAIN}) GROUP BY ALL)"""


def _event_terms(spark, sf):
    name = F.concat("event_type", F.lit("_user.file_"), (F.col("user_id") % 5).cast("string"), F.lit("-event tool"))
    return cluster.term_counts(table(spark, sf, "events").select("event_type", name.alias("name")), "event_type", "name")


@query("ag20_classify_groups", f"""WITH {_PAGE_TERMS}, kw(class, ord, term) AS (VALUES {_CLASS_SQL}), hits AS (SELECT grp, class, ord, sum(n) AS n FROM terms JOIN kw USING (term) GROUP BY ALL)
  SELECT grp, coalesce(class, 'Core') AS class FROM (SELECT DISTINCT grp FROM terms) LEFT JOIN (SELECT grp, class FROM hits QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, ord) = 1) USING (grp)""")
def ag20(spark, sf):
    return cluster.classify_groups(_event_terms(spark, sf))


@query("ag20_key_concepts", f"""WITH {_PAGE_TERMS}, kw(class, ord, term) AS (VALUES {_CLASS_SQL}), hits AS (SELECT grp, class, ord, sum(n) AS n FROM terms JOIN kw USING (term) GROUP BY ALL),
  cls AS (SELECT grp, class FROM hits QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, ord) = 1), r AS (SELECT grp, term, row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS r FROM terms JOIN cls USING (grp) WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.class = cls.class AND kw.term = terms.term))
  SELECT grp, string_agg(term, ',' ORDER BY r) AS concepts FROM r WHERE r <= 5 GROUP BY grp""")
def ag20b(spark, sf):
    t = _event_terms(spark, sf)
    return cluster.key_concepts(t, cluster.classify_groups(t))


def _ranked(spark, sf):
    """All rows of `embeddings` ranked for each query of the stated set: the vectors whose id is divisible by 50."""
    rows = table(spark, sf, "embeddings").where("embedding is not null")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("category"))
    scored = evaluate.score_blocks(rows.select(F.col("vec_id").alias("id"), "label", "embedding"), queries).where("id <> query")
    return evaluate.rank_results(scored)


_RANKED = """ranked AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, q.label AS category, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
  per AS (SELECT query, category, min(rank) FILTER (WHERE label = category) AS first_rank, coalesce(1 / (min(rank) FILTER (WHERE label = category))::DOUBLE, 0) AS rr, count(*) FILTER (WHERE label = category AND rank <= 10) / (count(*) FILTER (WHERE label = category))::DOUBLE AS r10,
  count(*) FILTER (WHERE label = category AND rank <= 20) / (count(*) FILTER (WHERE label = category))::DOUBLE AS r20 FROM ranked GROUP BY ALL)"""


@query("ev1_mrr_recall", f"WITH {_RANKED} SELECT query, first_rank, round(rr, 6) AS reciprocal_rank, round(r10, 6) AS recall_10, round(r20, 6) AS recall_20 FROM per")
def ev1(spark, sf):
    r = _ranked(spark, sf)
    e = evaluate.first_hits(r, r.where("label = category").select("query", "id"))
    return e.select("query", "first_rank", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall_10", "recall_20")])


@query("ev4_report", f"WITH {_RANKED}, x AS (SELECT category::VARCHAR AS category, rr, r10, r20 FROM per UNION ALL SELECT 'all', rr, r10, r20 FROM per) SELECT category, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(r10), 6) AS recall_10, round(avg(r20), 6) AS recall_20 FROM x GROUP BY category")
def ev4(spark, sf):
    r = _ranked(spark, sf)
    per = evaluate.first_hits(r, r.where("label = category").select("query", "id")).join(r.select("query", _key("category").alias("category")).distinct(), "query")
    return evaluate.report(per).select("category", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_10", "recall_20")])


@query("ev2_candidate_pool", f"WITH {_RANKED} SELECT query, id, min(ord) AS ord FROM (SELECT query, id, rank AS ord FROM ranked WHERE rank <= 50 UNION ALL SELECT query, id, 50 + row_number() OVER (PARTITION BY query ORDER BY id) FROM ranked WHERE label = category QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 50) GROUP BY ALL")
def ev2(spark, sf):
    r = _ranked(spark, sf)
    other = r.where("label = category").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return evaluate.candidate_pool([r, other])


@query("em2_cache_sync", """SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN b.doc_id IS NULL THEN 'embed' WHEN a.doc_id IS NULL THEN 'prune' ELSE 'keep' END AS action FROM documents a FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT -conv_id - 1 FROM conversations) b ON a.doc_id = b.doc_id""")
def em2(spark, sf):
    cached = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("key")).union(table(spark, sf, "conversations").select(-F.col("conv_id") - 1))
    return etl.sync_plan(table(spark, sf, "documents").select(F.col("doc_id").alias("key")), cached)


@query("nb2_field_commonality", "WITH t AS (SELECT count(DISTINCT o_orderstatus) AS k FROM orders) SELECT o_custkey AS path, count(DISTINCT o_orderstatus) AS n_buckets, CASE WHEN count(DISTINCT o_orderstatus) = any_value(k) THEN 'all' WHEN count(DISTINCT o_orderstatus) = 1 THEN 'unique' ELSE 'some' END AS scope FROM orders, t GROUP BY o_custkey")
def nb2(spark, sf):
    return etl.field_commonality(table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), "o_orderstatus"), ["o_orderstatus"])


@query("nb8_dangling_usages", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def nb8(spark, sf):
    uses = table(spark, sf, "events").select("event_id", "user_id", F.lit("c").alias("caller_compound"), _key("user_id").alias("caller_sig"))
    valid = table(spark, sf, "customer").where("c_nationkey < 12").select(F.lit("c").alias("compound"), _key("c_custkey").alias("signature"))
    return etl.dangling_usages(uses, valid).select("event_id", "user_id")


@query("nb9_judged_usages", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) FILTER (WHERE o_totalprice >= 150000) OVER (PARTITION BY o_custkey) AS kept FROM orders) WHERE o_totalprice >= 150000 OR kept = 0")
def nb9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("callee_id"), F.lit("").alias("caller_compound"), _key("o_orderkey").alias("caller_sig"), (F.col("o_totalprice") / 300000).alias("verdict_score"))
    out = etl.judge_usages(o.drop("verdict_score"), o.drop("o_orderkey"))
    return out.select("o_orderkey", F.col("callee_id").alias("o_custkey"))


@query("fn22_preceding_comments")
def fn22(spark, sf):
    from quillgraph.sources.artifacts import preceding_comments

    lines = table(spark, sf, "documents").where("text is not null").select(_key("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "t")).select("file", (F.col("i") + 1).alias("line"), F.when(F.col("i") % 2 == 0, F.concat(F.lit("// "), "t")).otherwise(F.col("t")).alias("text"))
    return preceding_comments(lines, lines.select("file", "line"))


@query("cl1_communities")
def cl1(spark, sf):
    return cluster.communities(brand_links(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight")))


@query("cl3_two_stage")
def cl3(spark, sf):
    links = brand_links(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    busy = links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "node").limit(2).select("node")
    return cluster.two_stage(links, busy)


@query("cl7_tfidf")
def cl7(spark, sf):
    rows, _ = cluster.tfidf(table(spark, sf, "documents"), "doc_id", "text")
    from pyspark.ml.functions import vector_to_array

    return rows.select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x > 0)).alias("n_terms"))


@query("cl8_topics")
def cl8(spark, sf):
    return cluster.topics(table(spark, sf, "documents"), "doc_id", "text", 5)[0]


@query("cl10_kmeans")
def cl10(spark, sf):
    return cluster.semantic_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("cl13_consensus")
def cl13(spark, sf):
    rows = table(spark, sf, "embeddings").where("label is not null")
    a = rows.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))
    b = cluster.semantic_clusters(rows, "vec_id", "embedding", 10).toDF("node", "cluster")
    return cluster.consensus([(a, 0.5), (b, 0.3)], 10)


@query("cl4_stable_clusters")
def cl4(spark, sf):
    rows = table(spark, sf, "embeddings")
    runs = None
    for r in range(3):
        one = cluster.semantic_clusters(rows, "vec_id", "embedding", 10, seed=r).select(F.lit(r).alias("run"), F.col("vec_id").alias("node"), "cluster")
        runs = one if runs is None else runs.unionByName(one)
    return cluster.stable_clusters(runs, 0.66)


@query("cl14_best_mapping")
def cl14(spark, sf):
    return cluster.best_mapping(*_labelings(spark, sf))


@query("fn12_minimal_embed_text", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[' || p_type || '] ' ELSE '' END || p_name || ' in ' || p_brand || '.cc' AS t FROM part")
def fn12(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", scalars.minimal_embed_text(kind, F.col("p_name"), F.lit(""), F.concat("p_brand", F.lit(".cc"))).alias("t"))


@query("fn20_function_name", "SELECT s_suppkey, 'Shop::~run_' || s_suppkey AS name FROM supplier")
def fn20(spark, sf):
    d = F.concat(F.lit("static const char *Shop::~run_"), _key("s_suppkey"), F.lit(" (int a, char b)"))
    return table(spark, sf, "supplier").select("s_suppkey", scalars.function_name(d).alias("name"))


@query("fn21_dependency_summary", "SELECT p_partkey, '- ' || p_type || ' ' || p_name || CASE WHEN p_size > 10 THEN ': ' || p_brand ELSE '' END AS line FROM part")
def fn21(spark, sf):
    brief = F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", scalars.dependency_summary(F.col("p_type"), F.col("p_name"), brief).alias("line"))


@query("fn23_has_documentation", "SELECT doc_id, quality IS NOT NULL OR (coalesce(lang, '') <> '' AND coalesce(source, '') <> '' AND doc_id % 2 = 0) AS ok FROM documents LEFT JOIN labels USING (doc_id)")
def fn23(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(scalars.has_documentation(_key("quality"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))), F.lit(False)).alias("ok"))


@query("j7_body_entity", """WITH c AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS entity, l_suppkey % 3 = 0 AS ext, l_suppkey % 5 = 0 AS body FROM lineitem), r AS (SELECT *, CASE WHEN NOT ext AND count(*) FILTER (WHERE NOT ext) OVER (PARTITION BY node) = 1 THEN 0 WHEN body THEN 1 WHEN entity % 2 = 0 THEN 2 ELSE 3 END AS k FROM c),
  b AS (SELECT node, entity, k AS rank FROM r QUALIFY row_number() OVER (PARTITION BY node ORDER BY k, entity) = 1)
  SELECT p_partkey AS node, CASE WHEN rank < 3 THEN entity END AS entity, CASE WHEN rank < 3 THEN rank END AS rank FROM part LEFT JOIN b ON p_partkey = node""")
def j7(spark, sf):
    s = F.col("l_suppkey")
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), s.alias("entity"), (s % 3 == 0).alias("extern"), (s % 5 == 0).alias("on_body"), F.when(s % 2 == 0, "a.cc").otherwise("a.hh").alias("path")).distinct()
    return etl.body_entity(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), c)


@query("nb3_entry_points", "SELECT c_custkey AS entity_id, 'do_' || c_custkey AS short_name, 'do_' AS entry_type FROM customer WHERE c_nationkey % 3 = 0")
def nb3(spark, sf):
    name = F.concat(F.when(F.col("c_nationkey") % 3 == 0, "do_").otherwise("get_"), _key("c_custkey"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("function").alias("kind"), name.alias("name"), F.concat(F.lit("void "), name, F.lit("(int)")).alias("signature"))
    return capability.entry_points(rows)


@query("nb5_locked_groups", f"""WITH {_CENTRES}, best AS (SELECT vec_id, CASE WHEN s >= 0.4 THEN label::VARCHAR ELSE 'uncategorized' END AS grp FROM (
  SELECT vec_id, cent.label, list_cosine_similarity(embedding::DOUBLE[], c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], c) DESC, cent.label::VARCHAR) AS r FROM embeddings, cent) WHERE r = 1)
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'locked' ELSE grp END AS grp FROM best""")
def nb5(spark, sf):
    rows = table(spark, sf, "embeddings")
    centres = cluster.group_sums(rows, "vec_id", "label", "embedding").select(_key("grp").alias("grp"), F.col("total").alias("centre"))
    locked = rows.where("vec_id % 7 = 0").select("vec_id", F.lit("locked").alias("grp"))
    return capability.classify(rows, centres, "vec_id", "embedding", locked=locked).select("vec_id", "grp")


@query("nb6_member_ranking", f"WITH {_PEERS} SELECT vec_id AS key, label AS grp, round(m, 6) AS mean, rank() OVER (PARTITION BY label ORDER BY round(m, 9) DESC) AS position FROM peers")
def nb6(spark, sf):
    p = cluster.peer_similarity(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    w = Window.partitionBy("grp").orderBy(F.desc(F.round("mean", 9)))
    return p.select("key", "grp", F.round("mean", 6).alias("mean"), F.rank().over(w).alias("position"))


@query("nb7_cohesion_summary", f"WITH {_PEERS} SELECT label AS grp, count(*) AS n, round(avg(m), 4) AS mean FROM peers GROUP BY label")
def nb7(spark, sf):
    return cluster.mean_cohesion(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").select("grp", "n", F.round("mean", 4).alias("mean"))


@query("nb4_depth_distribution", f"""WITH RECURSIVE {CALLS_SQL}, walk AS (SELECT 's:' || s_suppkey AS seed, 's:' || s_suppkey AS node, 0 AS depth FROM supplier
  UNION SELECT seed, dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 5), least AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL)
  SELECT depth, count(*) AS pairs, count(DISTINCT node) AS nodes FROM least WHERE depth > 0 GROUP BY depth""")
def nb4(spark, sf):
    return capability.depth_distribution(call_codes(spark, sf), supplier_codes(spark, sf))


@query("ev3_rerank", """WITH pool AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_totalprice AS a, length(o_orderpriority) * 20000.0 AS b FROM orders)
  SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY ord, id) AS rank_before, row_number() OVER (PARTITION BY query ORDER BY greatest(a, b) DESC, least(a, b) DESC, id) AS rank_after FROM pool""")
def ev3(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pool = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("ord"), F.col("o_totalprice").alias("doc_score"), (F.length("o_orderpriority") * 20000.0).alias("symbol_score"))
    return evaluate.rerank(pool).select("query", "id", "rank_before", "rank_after")


@query("src13_slice_source", """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS h FROM lines WHERE n BETWEEN 2 AND 4 GROUP BY doc_id""")
def src13(spark, sf):
    from quillgraph.sources.artifacts import slice_source

    docs = table(spark, sf, "documents").where("text is not null")
    lines = docs.select(_key("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")
    ents = docs.select("doc_id", _key("doc_id").alias("body_file"), F.lit(2).alias("body_start"), F.lit(3).alias("body_end"))
    return slice_source(ents, lines, "doc_id", after=1).select("doc_id", F.md5("source_text").alias("h"))


@query("snk8_comment_block", """SELECT p_partkey, '/**' || chr(10) || ' * @fn ' || p_name || chr(10) || ' * @brief ' || p_type || chr(10) || ' * ' || chr(10) || ' * @param ' || p_brand || ' ' || p_size || chr(10) || ' * ' || chr(10) || ' * @return ' || p_brand || chr(10) || ' */' AS comment FROM part""")
def snk8(spark, sf):
    from quillgraph.sources.sinks import comment_block

    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select("p_partkey", comment_block(F.col("p_name"), F.col("p_type"), F.lit(""), F.create_map("p_brand", _key("p_size")), F.col("p_brand"), none).alias("comment"))


@query("snk7_markdown", "SELECT n_regionkey, '## ' || n_regionkey || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def snk7(spark, sf):
    from quillgraph.sources.sinks import markdown_list

    return markdown_list(table(spark, sf, "nation"), "n_regionkey", F.col("n_name"), ["n_nationkey"])


@query("tl5_entry_points_like", r"SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000000__' ORDER BY c_name, c_custkey LIMIT 40")
def tl5(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").like("Customer#0000000__")).select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(40)


@query("tl4_capability_entry_points", """SELECT c_custkey, c_name FROM customer WHERE list_contains([c_mktsegment, 'x' || c_nationkey], 'x3') ORDER BY c_name, c_custkey LIMIT 20""")
def tl4(spark, sf):
    caps = F.array("c_mktsegment", F.concat(F.lit("x"), _key("c_nationkey")))
    return table(spark, sf, "customer").where(F.array_contains(caps, "x3")).select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(20)


@query("r15_hybrid_search")
def r15(spark, sf):
    """The whole search over parts as entities."""
    none = F.lit(None).cast("string")
    part = table(spark, sf, "part")
    name, qualified = F.col("p_name"), F.concat_ws("::", "p_brand", "p_name")
    sig = F.concat(F.lit("int "), name, F.lit("()"))
    ents = part.select(
        F.concat(F.lit("fn:"), _key("p_partkey")).alias("entity_id"), name.alias("name"), qualified.alias("qualified_name"), sig.alias("signature"), F.lit("function").alias("kind"), F.col("p_brand").alias("capability"),
        F.col("p_type").alias("brief"), none.alias("details"), F.lit(None).cast("map<string,string>").alias("params"), none.alias("returns"), none.alias("notes"), none.alias("rationale"), sig.alias("definition_text"),
        scalars.symbol_searchable(name, qualified, sig).alias("symbol_searchable"),
    )
    return retrieval.hybrid_search(ents, "polished steel part")
