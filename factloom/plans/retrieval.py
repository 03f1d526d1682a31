"""Search over the documents with the benchmark texts as question log, and over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import search, vectorindex, wordindex
from factloom.plans.registry import query
from factloom.plans.shared import forms_sql, long_words_sql, words_sql
from factloom.plans.texts import _LINES, _QT
from factloom.session import scratch_path


def _questions(t):
    return t.benchmark.select("item_id", tx.query_tokens(F.col("text")).alias("tokens"))


def _docs(t):
    return t.spread("documents").select("doc_id", "source", "text")


# search forms of a token, as in the vocabulary check: forms plus regular plurals that stay equivalent
def search_forms_sql(t: str) -> str:
    f = forms_sql(t)
    bases = (f"list_filter(CASE WHEN len(list_filter({f}, lambda x: length(x) < length({t}))) > 0 THEN list_filter({f}, lambda x: length(x) < length({t})) "
             f"WHEN {t} LIKE '%ws' THEN [] ELSE [{t}] END, lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}') AND x NOT IN ('as', 'is', 'us'))")
    return (f"list_distinct(list_concat({f}, list_transform({bases}, lambda x: CASE WHEN regexp_full_match(x, '.+[^aeiou]y') THEN x[:-2] || 'ies' "
            f"WHEN regexp_matches(x, '(s|x|z|ch|sh)$') THEN x || 'es' ELSE x || 's' END)))")


_SF = f"""qc AS (SELECT item_id, tok, unnest({search_forms_sql('tok')}) AS form FROM qt),
sf AS (SELECT item_id, tok, form FROM qc WHERE len(list_intersect({forms_sql('form')}, {forms_sql('tok')})) > 0)"""
_LEX = f"""{_QT}, {_SF},
dt AS (SELECT doc_id, unnest(list_distinct({words_sql('text')})) AS form FROM documents),
lx AS (SELECT item_id, doc_id, count(DISTINCT tok) AS matches FROM dt JOIN sf USING (form) GROUP BY 1, 2)"""


@query("lexical_search", f"""
WITH {_LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS rank FROM lx)
SELECT item_id, doc_id, matches, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 32""")
def lexical_search(t):
    return search.lexical_search(_docs(t), ["doc_id"], _questions(t), "item_id").select(
        "item_id", "doc_id", "matches", F.col("rank").cast("long").alias("rank"))


@query("indexed_search", f"""
WITH {_LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS rank FROM lx)
SELECT item_id, doc_id, matches, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 32""")
def indexed_search(t):
    index = wordindex.build_index(_docs(t), "doc_id", wordindex.text_words(F.col("text")), scratch_path(t.spark, "word-index"))
    return wordindex.index_search(index, _questions(t), "item_id", "doc_id").select("item_id", "doc_id", "matches", F.col("rank").cast("long").alias("rank"))


@query("indexed_coverage", f"""
WITH {_QT}, qf AS (SELECT item_id, tok, unnest({forms_sql('tok')}) AS form FROM qt),
dt AS (SELECT doc_id, unnest(list_distinct({long_words_sql('text')})) AS tok FROM documents),
df AS (SELECT DISTINCT doc_id, unnest({forms_sql('tok')}) AS form FROM dt)
SELECT doc_id, item_id, count(DISTINCT tok) AS coverage FROM df JOIN qf USING (form) GROUP BY 1, 2""")
def indexed_coverage(t):
    index = wordindex.build_index(_docs(t), "doc_id", wordindex.text_forms(F.col("text")), scratch_path(t.spark, "form-index"))
    return wordindex.index_coverage(index, _questions(t), "item_id", "doc_id")


_SEQ = "seq AS (SELECT item_id, rk, tok AS a FROM qt)"
_PAIRS = "seq AS (SELECT x.item_id, x.rk, x.tok AS a, y.tok AS b FROM qt x JOIN qt y ON y.item_id = x.item_id AND y.rk = x.rk + 1)"
_OV = lambda a, b: f"len(list_intersect({forms_sql(a)}, {forms_sql(b)})) > 0"


@query("label_first_search", f"""
WITH {_LEX}, {_SEQ},
lab AS (SELECT DISTINCT doc_id, lw FROM (SELECT doc_id, {words_sql('l')} AS lw FROM (SELECT doc_id, regexp_extract(p, '[\\p{{L}}\\p{{N}}\\s]*$') AS l FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\\s*(?:[:=|\t]|\\s[-–—]\\s|\\s(?:is|are|was|were)\\s)')[1:-2]) AS p FROM documents)))  WHERE len(lw) > 0),
tail AS (SELECT DISTINCT doc_id, lw[-1] AS z FROM lab),
hit AS (SELECT DISTINCT item_id, doc_id FROM tail JOIN (SELECT item_id, a, unnest({search_forms_sql('a')}) AS f FROM seq) s ON f = z
  WHERE {_OV('a', 'z')}),
m AS (SELECT item_id, doc_id, coalesce(matches, 0) AS matches, CASE WHEN hit.item_id IS NULL THEN 0 ELSE 1 END AS labelled FROM lx FULL JOIN hit USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY labelled DESC, matches DESC, doc_id) AS rank FROM m)
SELECT item_id, doc_id, matches, CAST(labelled AS BIGINT) AS labelled, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 20""")
def label_first_search(t):
    q = _questions(t)
    seqs = q.select("item_id", F.explode("tokens").alias("tok")).select("item_id", F.array("tok").alias("sequence"))
    out = search.lexical_search(_docs(t), ["doc_id"], q, "item_id", k=20, sequences=seqs)
    return out.select("item_id", "doc_id", "matches", F.col("labelled").cast("long").alias("labelled"), F.col("rank").cast("long").alias("rank"))


@query("weighted_search", f"""
WITH {_LEX}, {_PAIRS},
pos AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS tok FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)),
vocab AS (SELECT tok, {forms_sql('tok')} AS f FROM (SELECT DISTINCT tok FROM pos)),
sa AS (SELECT item_id, rk, v.tok FROM seq JOIN vocab v ON len(list_intersect({forms_sql('a')}, v.f)) > 0),
sb AS (SELECT item_id, rk, v.tok FROM seq JOIN vocab v ON len(list_intersect({forms_sql('b')}, v.f)) > 0),
ph AS (SELECT DISTINCT sa.item_id, x.doc_id FROM pos x JOIN sa USING (tok) JOIN pos y ON y.doc_id = x.doc_id AND y.p = x.p + 1
  JOIN sb ON sb.tok = y.tok AND sb.item_id = sa.item_id AND sb.rk = sa.rk),
s AS (SELECT item_id, doc_id, coalesce(matches, 0) * 10 + CASE WHEN ph.item_id IS NULL THEN 0 ELSE 25 END AS base FROM lx FULL JOIN ph USING (item_id, doc_id)),
z AS (SELECT item_id, doc_id, base + CASE WHEN contains(text, '|') THEN 8 ELSE 0 END AS score FROM s JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM z)
SELECT item_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def weighted_search(t):
    q = _questions(t)
    d = _docs(t).withColumn("has_table", F.col("text").contains("|"))
    pairs = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda second, i: F.array(F.get("tokens", i), second))
    out = search.weighted_lexical_search(d, ["doc_id"], q, "item_id", q.select("item_id", F.explode(pairs).alias("sequence")), "has_table", k=10)
    return out.select("item_id", "doc_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


_COS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a, e b),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)"""


@query("vector_search", f"WITH {_COS} SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM vr WHERE rank <= 5")
def vector_search(t):
    e = t.embeddings.select("vec_id", "embedding")
    out = search.vector_search(e, e.withColumnRenamed("vec_id", "query_id"), 5, dims=64)
    return out.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _indexed(t):
    e = t.embeddings.select("vec_id", "embedding")
    return e, vectorindex.build_index(e, scratch_path(t.spark, "vector-index"), dims=64, k=5)


@query("indexed_vector_search", f"WITH {_COS} SELECT query_id, vec_id, round(sim, 6) AS similarity FROM vr WHERE rank = 1")
def indexed_vector_search(t):
    """The nearest vector of every vector through the stored index: itself or an equal one with a smaller id, which any list keeps together."""
    e, index = _indexed(t)
    out = vectorindex.index_search(index, e.withColumnRenamed("vec_id", "query_id"), 5)
    return out.where("rank = 1").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_index_recall", """
SELECT count(*) AS questions, CAST(5 * count(*) AS BIGINT) AS results, TRUE AS enough, TRUE AS exact, TRUE AS fewer FROM embeddings""")
def vector_index_recall(t):
    """The index beside the exact search, over all vectors as questions: is the recall at least 0.9, are all similarities exact, are fewer pairs compared?"""
    e, index = _indexed(t)
    asked = e.withColumnRenamed("vec_id", "query_id")
    found = vectorindex.index_search(index, asked, 5).select("query_id", "vec_id", "similarity")
    best = search.vector_search(e, asked, 5, dims=64).select("query_id", "vec_id", F.col("similarity").alias("true"))
    held = index.lists.groupBy("list").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    pairs = e.crossJoin(held).agg((F.sum("n") * index.probes < F.count("*") * F.count("*")).alias("fewer"))  # one row on the right
    both = best.join(found, ["query_id", "vec_id"], "full_outer")
    out = both.agg(F.count_distinct("query_id").alias("questions"), F.count("similarity").alias("results"),
                   (F.count_if(F.col("true").isNotNull() & F.col("similarity").isNotNull()) / F.count("true") >= 0.9).alias("enough"),
                   F.coalesce(F.bool_and(F.abs(F.col("true") - F.col("similarity")) < 1e-8), F.lit(True)).alias("exact"))
    return out.crossJoin(pairs)


@query("vector_index_lists", "SELECT vec_id, CAST(1 AS BIGINT) AS lists FROM embeddings")
def vector_index_lists(t):
    """Every vector is in one inverted list."""
    return _indexed(t)[1].lists.groupBy("vec_id").agg(F.count_distinct("list").alias("lists"))


@query("vector_search_in_blocks", f"WITH {_COS} SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank FROM vr WHERE rank <= 3")
def vector_search_in_blocks(t):
    """The same with several blocks of questions."""
    e = t.embeddings.select("vec_id", "embedding")
    out = search.vector_search(e, e.withColumnRenamed("vec_id", "query_id"), 3, dims=64, query_blocks=3)
    return out.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("vector_problems", """
SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'zero' WHEN vec_id % 50 = 1 THEN 'wrong_dimensions' WHEN vec_id % 50 = 2 THEN 'not_finite'
  WHEN vec_id % 50 = 3 THEN 'missing' ELSE 'fine' END AS reason FROM embeddings""")
def vector_problems(t):
    m = F.col("vec_id") % 50
    v = (F.when(m == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(m == 1, F.slice("embedding", 1, 10))
         .when(m == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).when(m == 3, F.lit(None)).otherwise(F.col("embedding")))
    return search.validate_vectors(t.embeddings.select("vec_id", v.alias("embedding")), 64).select(
        "vec_id", F.coalesce("reason", F.lit("fine")).alias("reason"))


@query("hybrid_search", f"""
WITH {_LEX}, {_COS}, l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS r FROM lx),
u AS (SELECT item_id, doc_id, r AS f FROM l WHERE r <= 8 UNION ALL SELECT query_id, vec_id, 1000 + rank FROM vr
  WHERE rank <= 8 AND query_id IN (SELECT item_id FROM benchmark)),
m AS (SELECT item_id, doc_id, min(f) AS f FROM u GROUP BY 1, 2)
SELECT item_id, doc_id, CAST(f // 1000 AS INT) AS lane, CAST(row_number() OVER (PARTITION BY item_id ORDER BY f, doc_id) AS BIGINT) AS position FROM m""")
def hybrid_search(t):
    lex = search.lexical_search(_docs(t), ["doc_id"], _questions(t), "item_id", k=8)
    e = t.embeddings.select("vec_id", "embedding")
    asked = e.withColumnRenamed("vec_id", "query_id").join(
        t.benchmark.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    vec = search.vector_search(e, asked, 8, dims=64).select(
        F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    return search.hybrid_search(lex, vec, "item_id", "doc_id").withColumn("position", F.col("position").cast("long"))


@query("selected_passages", f"""
WITH {_LEX}, c0 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, doc_id) AS pos FROM lx),
c AS (SELECT * FROM c0 WHERE pos <= 32), qf AS (SELECT item_id, tok, unnest({forms_sql('tok')}) AS form FROM qt),
df AS (SELECT DISTINCT doc_id, source, unnest({forms_sql('w')}) AS form FROM (SELECT doc_id, source,
  unnest(list_distinct({long_words_sql("source || chr(10) || text")})) AS w FROM documents)),
cov AS (SELECT c.item_id, c.doc_id, c.pos, df.source, count(DISTINCT tok) AS coverage FROM c JOIN df USING (doc_id) JOIN qf ON qf.form = df.form AND qf.item_id = c.item_id GROUP BY 1, 2, 3, 4),
b AS (SELECT *, max(coverage) OVER (PARTITION BY item_id) AS best FROM cov),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY coverage DESC, pos) AS s FROM b WHERE coverage >= CASE WHEN best >= 2 THEN 2 ELSE 1 END),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, pos) AS position FROM k WHERE s <= 3)
SELECT item_id, doc_id, coverage, CAST(position AS BIGINT) AS position FROM z WHERE position <= 6""")
def selected_passages(t):
    cand = search.lexical_search(_docs(t), ["doc_id"], _questions(t), "item_id").select("item_id", "doc_id", F.col("rank").alias("position"))
    out = search.select_passages(cand, _docs(t), _questions(t), "item_id", "doc_id", per=3, total=6)
    return out.select("item_id", "doc_id", "coverage", F.col("position").cast("long").alias("position"))


_BEST = f"""{_QT}, qs AS (SELECT item_id, list(tok ORDER BY rk) AS toks FROM qt GROUP BY 1), {_LINES},
w1 AS (SELECT doc_id, text AS line, start, start + length(text) AS stop, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM n),
w2 AS (SELECT *, lead(stop) OVER v AS stop2, lead(stop, 2) OVER v AS stop3 FROM w1 WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, 1 AS wd, start, stop FROM w2 UNION ALL SELECT doc_id, i, 2, start, stop2 FROM w2 WHERE stop2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 3, start, stop3 FROM w2 WHERE stop3 IS NOT NULL),
nq AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT win.*, qs.toks, {long_words_sql('substr(d.text, start + 1, stop - start)')} AS ws FROM win JOIN documents d USING (doc_id), nq JOIN qs ON qs.item_id = d.doc_id % nq.n),
c AS (SELECT doc_id, i, wd, start, stop, len(list_filter(toks, lambda q: len(list_intersect({forms_sql('q')}, flatten(list_transform(ws, lambda y: {forms_sql('y')})))) > 0)) AS coverage FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN coverage > 0 THEN coverage ELSE 0 END DESC, CASE WHEN coverage > 0 THEN stop - start ELSE 0 END, i, wd) AS k FROM c)"""


@query("best_excerpts", f"WITH {_BEST} SELECT doc_id, start, stop, coverage FROM r WHERE k = 1")
def best_excerpts(t):
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))
    d = t.spread("documents").select("doc_id", "text").withColumn("item_id", F.col("doc_id") % n.scalar())
    j = d.join(_questions(t), "item_id").select("doc_id", search.best_excerpt(F.col("text"), F.col("tokens")).alias("e"))
    return j.select("doc_id", *[F.col(f"e.{c}").cast("long").alias(c) for c in ("start", "stop", "coverage")])


@query("narrowed_excerpts", f"""
WITH {_BEST},
best AS (SELECT r.doc_id, r.start, r.stop, text, qs.toks, substr(text, r.start + 1, r.stop - r.start) AS body FROM r JOIN documents USING (doc_id), nq
  JOIN qs ON qs.item_id = r.doc_id % nq.n WHERE k = 1),
cut_words AS (SELECT *, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(body, '[\\p{{L}}\\p{{N}}]+') AS gaps,
  flatten(list_transform(toks, lambda q: {forms_sql('q')})) AS asked FROM best),
first_hit AS (SELECT *, list_position(list_transform(ws, lambda w: len(list_intersect({forms_sql('lower(w)')}, asked)) > 0), true) AS i FROM cut_words),
hits AS (SELECT *, start + CASE WHEN coalesce(i, 0) = 0 THEN 0 ELSE length(array_to_string(gaps[1:i], '')) + length(array_to_string(ws[1:i - 1], '')) END AS hit FROM first_hit),
lows AS (SELECT *, greatest(start, least(hit - 80, stop - 280)) AS low, length(regexp_extract(substr(text, start + 1, hit - start), '(?s)^.*\\. ')) AS sentence FROM hits),
blanks AS (SELECT *, instr(substr(text, low + 1, least(24, hit - low)), ' ') AS blank FROM lows),
cuts AS (SELECT *, CASE WHEN low > start AND sentence > 0 AND hit - (start + sentence) <= 280 THEN start + sentence WHEN low > start AND blank > 0 THEN low + blank ELSE low END AS cut FROM blanks),
spans AS (SELECT doc_id, text, CASE WHEN stop - start <= 280 THEN start ELSE cut END AS start, CASE WHEN stop - start <= 280 THEN stop WHEN cut + 280 >= stop THEN least(stop, cut + 280)
  ELSE cut + coalesce(nullif(length(regexp_extract(substr(text, cut + 1, 280), '(?s)^(.*) [^ ]{{0,23}}$', 1)), 0), 280) END AS stop FROM cuts)
SELECT doc_id, start, stop, substr(text, start + 1, stop - start) AS excerpt FROM spans""")
def narrowed_excerpts(t):
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))
    d = t.spread("documents").select("doc_id", "text").withColumn("item_id", F.col("doc_id") % n.scalar())
    j = d.join(_questions(t), "item_id").withColumn("e", search.best_excerpt(F.col("text"), F.col("tokens")))
    j = j.withColumn("n", search.narrow_excerpt(F.col("text"), F.col("e"), F.col("tokens")))
    return j.select("doc_id", F.col("n.start").cast("long").alias("start"), F.col("n.stop").cast("long").alias("stop"), F.substring("text", F.col("n.start") + 1, F.col("n.stop") - F.col("n.start")).alias("excerpt"))


@query("value_anchors", """
SELECT o_orderkey, 'assignment' AS form, 'Total price: $' || CAST(o_custkey AS STRING) || '0' AS anchor FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'distance', 'price went up by ' || CAST(o_custkey AS STRING) || '.5%' FROM orders WHERE o_orderkey % 2 = 1""")
def value_anchors(t):
    text = ("CASE WHEN o_orderkey % 2 = 0 THEN 'Seen by desk 4' || chr(10) || 'Total price: $' || CAST(o_custkey AS STRING) || '0' "
            "ELSE 'The price went up by ' || CAST(o_custkey AS STRING) || '.5% on 2020-01-01' END")
    d = t.spread("orders").selectExpr("o_orderkey", f"{text} AS text").withColumn("a", search.value_anchor(F.col("text"), F.array(F.lit("prices"))))
    return d.where("a IS NOT NULL").select("o_orderkey", "a.form", F.substring("text", F.col("a.start") + 1, F.col("a.stop") - F.col("a.start")).alias("anchor"))


@query("label_sequences", f"""
WITH {_QT}, l AS (SELECT item_id, list(tok ORDER BY rk) AS q FROM qt GROUP BY 1), c AS (SELECT item_id, q FROM l),
s AS (SELECT item_id, q[i:] AS seq FROM (SELECT item_id, q, unnest(generate_series(1, len(q))) AS i FROM c)
UNION SELECT item_id, q[i:i + w - 1] FROM (SELECT item_id, q, w, unnest(generate_series(1, len(q) - w + 1)) AS i FROM c, (VALUES (2), (3), (4)) v(w))
UNION SELECT item_id, list_reverse(q) FROM c WHERE len(q) BETWEEN 2 AND 4)
SELECT item_id, array_to_string(seq, ' ') AS sequence FROM s""")
def label_sequences(t):
    q = t.benchmark.select("item_id", tx.query_tokens(F.col("text")).alias("q"))
    return q.select("item_id", F.explode(search.assignment_sequences(F.col("q"))).alias("s")).select("item_id", F.array_join("s", " ").alias("sequence"))


# questions rendered from parts: a scope behind "for", an owner before "in", a doer, "of" alone, and a preposition with nothing behind it
_SCOPED = """CASE p_partkey % 5 WHEN 0 THEN 'What is the ' || p_type || ' for ' || p_name || '?' WHEN 1 THEN p_brand || ' of ' || p_name || ' in ' || p_type
  WHEN 2 THEN 'Who may approve ' || p_name || ' in ' || p_type WHEN 3 THEN 'Owner of ' || p_name ELSE p_name || ' on' END"""


@query("scoped_label_sequences", f"""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, lower(p_type) AS ty, p_name AS nm, string_split(p_name, ' ')[1] AS n1, string_split(p_name, ' ')[2] AS n2,
  array_to_string({words_sql('p_brand')}, ' ') AS br FROM part)
SELECT p_partkey, unnest(CASE k WHEN 0 THEN [ty, CASE WHEN ty = n1 THEN nm ELSE ty || ' ' || nm END] WHEN 1 THEN [br || ' of ' || nm] WHEN 2 THEN []
  WHEN 3 THEN ['owner', 'owner of ' || nm] ELSE [nm || ' on', n2 || ' on', 'on', nm, 'on ' || n2 || ' ' || n1] END) AS sequence FROM p""")
def scoped_label_sequences(t):
    q = t.part.select("p_partkey", F.explode(search.question_sequences(F.expr(_SCOPED))).alias("s"))
    return q.select("p_partkey", F.array_join("s", " ").alias("sequence"))


@query("extractive_answers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 3 END AS ord FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 1""")
def extractive_answers(t):
    q = ("CASE o_orderkey % 3 WHEN 0 THEN 'What is the agreed premium' WHEN 1 THEN 'Who is the named carrier' ELSE 'When was the binder issued' END")
    p = t.orders.selectExpr("o_orderkey", f"{q} AS question", """inline(array(
        struct(1 AS ord, 'The named carrier of the agreed premium is what they say' AS quote, 'carrier.txt' AS source),
        struct(2 AS ord, concat('What is agreed: premium $', o_custkey, '00') AS quote, 'premium.txt' AS source),
        struct(3 AS ord, 'The binder was issued when agreed, on March 3, 2021' AS quote, 'binder.txt' AS source),
        struct(4 AS ord, 'The binder was issued when agreed' AS quote, 'binder.txt' AS source)))""")
    return search.extractive_answer(p, "o_orderkey", "question", "quote", "source", "ord").select("o_orderkey", "ord")
