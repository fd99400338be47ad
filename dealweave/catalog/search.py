"""Text, vectors, search and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import chunks_of, query, ts
from dealweave.catalog.rowsets import as_of
from dealweave.functions.hashing import request_key
from dealweave.operators.chunks import chunk_documents
from dealweave.operators.pivots import pivot_index, pivot_top_k
from dealweave.operators.postings import keyword_search, postings, query_terms, term_df
from dealweave.operators.rows import spread
from dealweave.operators.vectors import vector_top_k
from dealweave.plans.answers import (
    HEADING_WORDS, REMARK_WORDS, bold_names, cache_lookup, cache_update, contained_tables, drop_ungrounded, full_coverage,
    mentioned_names, source_links, ungrounded_names)
from dealweave.plans.documents import newest_rules
from dealweave.plans.search import embed_pending, embed_queries, hybrid_search, memory_context, similar_items

_POSTINGS = """
    words as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents),
    posts as (select 'doc' || doc_id::varchar as id, term, count(*) as tf from words where term <> '' group by 1, 2),
    freq as (select term, count(*) as ndoc from posts group by 1)"""
_KEYWORDS = _POSTINGS + """,
    asked_words as (select distinct item_id as query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from benchmark),
    terms as (select query_id, term from asked_words where term <> ''),
    kw as (select query_id, id, sum(tf)::bigint as keyword_score from terms join posts using (term) group by 1, 2),
    kr as (select *, row_number() over (partition by query_id order by keyword_score desc, id) as rank from kw)"""
_VECTORS = """
    sims as (select a.query_id, v.id, round(list_cosine_similarity(a.vector::double[], v.embedding::double[]), 9) as similarity
      from asked a join vecs v on true where a.vector is not null),
    vr as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims)"""


@query("chunk_documents", f"with recursive {chunks_of('select doc_id as id, text as txt, 1600 as size from documents').strip()}" + """
    select id as doc_id, part::bigint as part, chunk, parts::bigint as parts from cut""")
def chunk_documents_query(t):
    return chunk_documents(spread(t.documents), "doc_id", "text", 1600)


@query("term_df", f"with {_POSTINGS.strip()} select term, ndoc from freq")
def term_df_query(t):
    return term_df(postings(t.docs, "id", "body"))


@query("keyword_search", f"with {_KEYWORDS.strip()} select query_id, id, keyword_score, rank from kr where rank <= 60")
def keyword_search_query(t):
    posts = postings(t.docs, "id", "body")
    return keyword_search(query_terms(t.asked, "query_id", "text"), posts, 60)


@query("vector_top_k", f"""with {_VECTORS.strip()}
    select query_id, id, round(similarity, 6) as similarity, rank from vr where rank <= 60""")
def vector_top_k_query(t):
    return vector_top_k(t.asked.filter("vector is not null"), t.vecs, 60).withColumn(
        "similarity", F.round("similarity", 6))


@query("pivot_search", f"""with {_VECTORS.strip()}
    select query_id, id, round(similarity, 6) as similarity, rank from vr where rank <= 20""")
def pivot_search_query(t):
    hits, _ = pivot_top_k(t.asked, pivot_index(t.vecs), 20)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("pivot_reads", """
    select query_id, (select count(*) from vecs) as stored, true as enough, true as within from asked where vector is not null""")
def pivot_reads_query(t):
    """Vectors that each question was compared with: at least as many as it returns, at most as there are."""
    _, reads = pivot_top_k(t.asked, pivot_index(t.vecs), 20)
    return reads.select("query_id", "stored", (F.col("compared") >= F.least(F.lit(20), F.col("stored"))).alias("enough"),
                        (F.col("compared") <= F.col("stored")).alias("within"))


@query("hybrid_search", f"""with {_KEYWORDS.strip()}, {_VECTORS.strip()},
    f as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.id, k.id) as id, v.similarity,
        round(coalesce(1.3::double / (60::double + v.rank), 0) + coalesce(1::double / (60::double + k.rank), 0), 9) as score
      from (select * from vr where rank <= 60) v full join (select * from kr where rank <= 60) k on v.query_id = k.query_id and v.id = k.id),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as position from f)
    select query_id, r.id, position, score, round(similarity, 6) as similarity, d.kind, d.title, d.body as snippet
    from r join docs d on d.id = r.id where position <= 10""")
def hybrid_search_query(t):
    posts = postings(t.docs, "id", "body")
    found = hybrid_search(t.asked, t.docs, t.vecs, posts, 10, 60)
    return found.select("query_id", "id", "position", "score", F.round("similarity", 6).alias("similarity"), "kind", "title", "snippet")


@query("filtered_search", f"""with
    words as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents),
    posts as (select 'doc' || doc_id::varchar as id, term, count(*) as tf from words where term <> '' group by 1, 2),
    freq as (select term, count(*) as ndoc from posts group by 1),
    ok as (select 'doc' || doc_id::varchar as id from documents where source in ('src1', 'src2', 'src3', 'src4') and lang = 'en'),
    asked_words as (select distinct item_id as query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from benchmark),
    terms as (select query_id, term from asked_words where term <> ''),
    kw as (select query_id, id, sum(tf)::bigint as s from terms join posts using (term) where id in (select id from ok) group by 1, 2),
    kr as (select *, row_number() over (partition by query_id order by s desc, id) as rank from kw),
    sims as (select a.query_id, v.id, round(list_cosine_similarity(a.vector::double[], v.embedding::double[]), 9) as similarity
      from asked a join vecs v on true where a.vector is not null and v.id in (select id from ok)),
    vr as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims),
    f as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.id, k.id) as id,
        round(coalesce(1.3::double / (60::double + v.rank), 0) + coalesce(1::double / (60::double + k.rank), 0), 9) as score
      from (select * from vr where rank <= 60) v full join (select * from kr where rank <= 60) k on v.query_id = k.query_id and v.id = k.id),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as position from f)
    select query_id, id, position, score from r where position <= 5""")
def filtered_search_query(t):
    posts = postings(t.docs, "id", "body")
    found = hybrid_search(t.asked, t.docs, t.vecs, posts, 5, 60, ["src1", "src2", "src3", "src4"], {"lang": "en"})
    return found.select("query_id", "id", "position", "score")


@query("similar_items", """
    with q as (select 'doc' || item_id::varchar as query_id from benchmark),
    s as (select q.query_id, d.id, round(list_cosine_similarity(v.embedding::double[], d.embedding::double[]), 9) as similarity
      from q join vecs v on v.id = q.query_id join vecs d on d.id <> q.query_id),
    r as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s)
    select query_id, r.id, rank, round(similarity, 6) as similarity, d.kind, d.body as snippet
    from r join docs d on d.id = r.id where rank <= 10""")
def similar_items_query(t):
    ids = t.benchmark.select(F.concat(F.lit("doc"), F.col("item_id").cast("string")).alias("id"))
    return similar_items(ids, t.vecs, t.docs, 10).select(
        "query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), "kind", "snippet")


@query("memory_context", f"""with {_KEYWORDS.strip()}, {_VECTORS.strip()},
    mv as (select s.query_id, s.id, similarity, row_number() over (partition by s.query_id order by similarity desc, s.id) as rank from sims s
      join docs d on d.id = s.id where d.kind in ('src0', 'src1', 'src2')),
    mk as (select k.query_id, k.id, row_number() over (partition by k.query_id order by keyword_score desc, k.id) as rank from kw k
      join docs d on d.id = k.id where d.kind in ('src0', 'src1', 'src2')),
    mf as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.id, k.id) as id, similarity,
        round(coalesce(1.3::double / (60::double + v.rank), 0) + coalesce(1::double / (60::double + k.rank), 0), 9) as score
      from (select * from mv where rank <= 60) v full join (select * from mk where rank <= 60) k on v.query_id = k.query_id and v.id = k.id),
    mr as (select *, row_number() over (partition by query_id order by score desc, id) as position from mf),
    mem as (select query_id, string_agg(id || ' ' || round(similarity, 3)::decimal(10,3)::varchar, ', ' order by position) as memory
      from mr where position <= 6 and coalesce(similarity, 0) >= 0.2 group by 1),
    hv as (select s.query_id, s.id, row_number() over (partition by s.query_id order by similarity desc, s.id) as rank from sims s
      join docs d on d.id = s.id where d.kind in ('src3', 'src4', 'src5', 'src6')),
    hk as (select k.query_id, k.id, row_number() over (partition by k.query_id order by keyword_score desc, k.id) as rank from kw k
      join docs d on d.id = k.id where d.kind in ('src3', 'src4', 'src5', 'src6')),
    hf as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.id, k.id) as id,
        round(coalesce(1.3::double / (60::double + v.rank), 0) + coalesce(1::double / (60::double + k.rank), 0), 9) as score
      from (select * from hv where rank <= 60) v full join (select * from hk where rank <= 60) k on v.query_id = k.query_id and v.id = k.id),
    hr as (select *, row_number() over (partition by query_id order by score desc, id) as position from hf),
    hits as (select query_id, string_agg(hr.id || ' ' || d.kind || ' ' || d.body, ', ' order by position) as hits
      from hr join docs d on d.id = hr.id where position <= 8 group by 1)
    select a.query_id, memory, hits, null as rule_id, null as rule_created_at, null as rule
    from asked a left join mem on mem.query_id = a.query_id left join hits on hits.query_id = a.query_id
    union all select null, null, null, id, {ts('created_at')}, rule from rules where active""")
def memory_context_query(t):
    """A row for each question, and the active rules that go with every question, a row each, once."""
    posts = postings(t.docs, "id", "body")
    found = memory_context(
        t.asked, t.docs, t.vecs, posts, 8, 6, 60, hit_kinds=["src3", "src4", "src5", "src6"],
        memory_kinds=["src0", "src1", "src2"], min_similarity=0.2)
    memory = F.transform("memory", lambda m: F.concat(
        m["id"], F.lit(" "), m["similarity"].cast("decimal(10,3)").cast("string")))
    hits = F.transform("hits", lambda h: F.concat_ws(" ", h["id"], h["kind"], h["snippet"]))
    asked = found.select("query_id", memory.alias("memory"), hits.alias("hits"))
    rules = newest_rules(t.rules).select(F.col("id").alias("rule_id"), F.col("created_at").alias("rule_created_at"), "rule")
    return asked.unionByName(rules, allowMissingColumns=True)


@query("memory_rules", f"select id, {ts('created_at')} as created_at, rule from rules where active")
def memory_rules_query(t):
    """The active rules that go with every question's memory, one row each however many there are."""
    return newest_rules(t.rules).select("id", "created_at", "rule")


# --- embeddings ------------------------------------------------------------------------------------------------

@query("embed_pending", """
    select 'doc' || doc_id::varchar as id, source as kind, 64::bigint as dimensions,
      case when doc_id in (select vec_id from embeddings) then '2024-01-01 00:00:00' else '2024-01-31 00:00:00' end as embedded_at from documents""")
def embed_pending_query(t):
    held = t.vecs.select("id", "embedding")
    docs = t.docs.join(held, "id", "left").withColumn(
        "embedded_at", F.when(F.col("embedding").isNotNull(), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    done = embed_pending(docs, as_of())
    return done.select("id", "kind", F.size("embedding").alias("dimensions"), "embedded_at")


@query("embed_queries", r"""
    with q as (select id, lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) as q from log)
    select q.q, count(*) as asked, c.q is null as is_new from q
    left join (select distinct lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) as q from log where error is not null) c on c.q = q.q
    group by q.q, c.q""")
def embed_queries_query(t):
    """All questions of the log; the ones of failed rows are already cached."""
    log = t.log.select("id", F.col("question").alias("text"), "error")
    old = F.lit("2024-01-20 00:00:00").cast("timestamp")
    cached = log.filter("error is not null").select(F.lower("text").alias("q")).distinct().select(
        "q", F.array(F.lit(1.0).cast("float")).alias("embedding"), old.alias("used_at"))
    answered, _ = embed_queries(log.drop("error"), cached, as_of())
    return answered.groupBy(F.lower("text").alias("q")).agg(
        F.count(F.lit(1)).alias("asked"), F.bool_and(F.size("vector") > 1).alias("is_new"))


@query("embed_cache", """
    select count(*) as entries, sum(case when used_at = timestamp '2024-01-31' then 1 else 0 end)::bigint as touched from (
      select q, max(case when asked then timestamp '2024-01-31' else used end) as used_at from (
        select lower(question) as q, timestamp '2024-01-20' as used, true as asked from log
        union all select 'old ' || lower(question), timestamp '2023-12-01', false from log where error is not null) group by q)
    where used_at >= timestamp '2024-01-31' - interval 30 day""")
def embed_cache(t):
    log = t.log.select("id", F.col("question").alias("text"), "error")

    def entries(prefix, day):
        return log.filter("error is not null").select(F.concat(F.lit(prefix), F.lower("text")).alias("q")).distinct().select(
            "q", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(day).cast("timestamp").alias("used_at"))

    cache = entries("", "2024-01-20 00:00:00").unionByName(entries("old ", "2023-12-01 00:00:00"))
    _, state = embed_queries(log.drop("error"), cache, as_of())
    return state.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("used_at") == as_of()).alias("touched"))


# --- answers ---------------------------------------------------------------------------------------------------

_ANSWERS = r"""
    a as (select conv_id as answer_id, turn, lower(text) as t, '**' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '** and **'
        || split_part(text, ' ', 3) || ' (x)**: **Deal 5** **Note: **' || chr(10) || text as answer from conversations where role = 'assistant'),
    n as (select distinct conv_id, turn, trim(unnest(regexp_extract_all(answer, '\*\*(.+?)\*\*', 1))) as name from (select answer_id as conv_id, turn, answer from a))"""


# The name rules with the word lists they share with the operator.
_NAME_RULES = rf""",
    f as (select * from n where length(name) > 2 and not regexp_matches(name, '\d|[:?]$') and not regexp_matches(name, '(?i)^({'|'.join(REMARK_WORDS)})\b')
      and (len(string_split(name, ' ')) <= 2 or not regexp_matches(name, '(?i)\b({'|'.join(HEADING_WORDS)})\b')))"""


def answers_of(t):
    """Answers with bold names made of their own first words, as they would be marked in a reply."""
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    bold = F.concat(F.lit("**"), word(1), F.lit(" "), word(2), F.lit("** and **"), word(3), F.lit(" (x)**: **Deal 5** **Note: **\n"), "text")
    rows = t.conversations.filter("role = 'assistant'")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "conv_id", F.lit("").alias("question"),
                       bold.alias("answer"))


@query("bold_names", f"with {_ANSWERS.strip()}" + _NAME_RULES + r"""
    select conv_id::varchar || '-' || turn::varchar as answer_id, name from f""")
def bold_names_query(t):
    return bold_names(answers_of(t))


_UNGROUNDED = f"with {_ANSWERS.strip()}" + _NAME_RULES + r""",
    k as (select *, trim(regexp_replace(lower(name), '\s*\(.*?\)\s*', ' ', 'g')) as key from f),
    u as (select conv_id, turn, name from k
      where not exists (select 1 from conversations c where c.conv_id = k.conv_id and c.role = 'user' and contains(lower(c.text), key)))"""


@query("grounding_check", _UNGROUNDED + " select conv_id::varchar || '-' || turn::varchar as answer_id, name from u")
def grounding_check(t):
    """Evidence of an answer: what the user said in the same conversation."""
    answers = answers_of(t)
    said = t.conversations.filter("role = 'user'").select("conv_id", "text")
    evidence = answers.select("answer_id", "conv_id").join(said, "conv_id").select("answer_id", "text")
    return ungrounded_names(answers, evidence)


@query("grounding_cleanup", _UNGROUNDED + r"""
    select b.answer_id::varchar || '-' || b.turn::varchar as answer_id, array_to_string(list_filter(string_split(b.answer, chr(10)),
        lambda l: len(list_filter(coalesce(g.bad, []), lambda n: contains(l, n))) = 0), chr(10)) as answer, coalesce(len(g.bad), 0)::bigint as removed_names
    from a b left join (select conv_id, turn, list(distinct name) as bad from u group by 1, 2) g on g.conv_id = b.answer_id and g.turn = b.turn""")
def grounding_cleanup(t):
    answers = answers_of(t)
    said = t.conversations.filter("role = 'user'").select("conv_id", "text")
    evidence = answers.select("answer_id", "conv_id").join(said, "conv_id").select("answer_id", "text")
    return drop_ungrounded(answers, ungrounded_names(answers, evidence)).select("answer_id", "answer", "removed_names")


def result_tables(t):
    """Turns of a conversation as result tables: one table per turn, one row per line, one cell per sentence."""
    lines = t.conversations.select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("table_no"), F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return lines.select("answer_id", "table_no", "row_no", F.explode(F.split("line", "[.,]")).alias("value"), F.lit(False).alias("numeric"))


@query("table_coverage", """
    with cells as (select conv_id as a, turn as t, r.i as r, trim(regexp_replace(lower(c.v), '[^a-z0-9.]+', ' ', 'g')) as v from conversations,
        unnest(string_split(text, chr(10))) with ordinality as r(line, i), unnest(string_split_regex(r.line, '[.,]')) as c(v)),
    rws as (select a, t, r, coalesce(list(v) filter (where v <> ''), []) as cs from cells group by a, t, r),
    sz as (select a, t, count(*) as n from rws group by a, t),
    fr as (select a, t, c, count(*) as n from (select a, t, r, unnest(list_distinct(cs)) as c from rws) group by 1, 2, 3),
    rare as (select x.a, x.t, x.r, x.cs, f.t as bt, f.c, row_number() over (partition by x.a, x.t, x.r, f.t order by f.n, f.c) as i
      from (select a, t, r, cs, unnest(list_distinct(cs)) as c from rws) x join fr f on f.a = x.a and f.c = x.c and f.t <> x.t),
    hit as (select distinct k.a, k.t, k.r, k.bt from rare k join rws b on b.a = k.a and b.t = k.bt and list_contains(b.cs, k.c) where k.i = 1
      and len(list_filter(k.cs, lambda c: list_contains(b.cs, c) or (length(c) > 3 and len(list_filter(b.cs, lambda x: contains(x, c))) > 0))) >= 0.9 * len(k.cs)),
    em as (select a, t, count(*) as n from rws where len(cs) = 0 group by a, t),
    pr as (select p.a, p.t, q.t as bt, p.n, q.n as bn, coalesce((select count(*) from hit h where h.a = p.a and h.t = p.t and h.bt = q.t), 0)
        + coalesce(em.n, 0) as cov from sz p join sz q on q.a = p.a and q.t <> p.t left join em on em.a = p.a and em.t = p.t),
    cv as (select * from pr where n <= bn and cov >= 0.95 * n)
    select sz.a as answer_id, sz.t as table_no, not exists (select 1 from cv x where x.a = sz.a and x.t = sz.t
      and (x.bt > x.t or not exists (select 1 from cv y where y.a = x.a and y.t = x.bt and y.bt = x.t))) as kept from sz""")
def table_coverage_query(t):
    return contained_tables(result_tables(t))


_ORDER_CELLS = """
    orders_of as (select o_custkey as a, o_orderkey as k, o_orderstatus as st, o_orderpriority as pri, o_orderdate as d,
        cast(extract(year from o_orderdate) as {text}) as y from {orders}),
    summaries as (select a, count(*) as n, sum(case when st = 'F' then 1 else 0 end) as f from orders_of group by a),
    result_cells as (
      select a, 1 as t, k as r, concat('order ', k) as v, false as num from orders_of union all
      select a, 1, k, y, false from orders_of union all select a, 1, k, pri, false from orders_of union all
      select a, 2, k, concat('Order ', k, '!'), false from orders_of where st = 'F' union all
      select a, 2, k, substring(pri, 3), false from orders_of where st = 'F' union all
      select a, 3, 0, cast(n as {text}), true from summaries union all select a, 3, 0, cast(f as {text}), true from summaries union all
      select a, 4, k, concat('order ', k), false from orders_of where st <> 'F' union all
      select a, 4, k, cast(d as {text}), false from orders_of where st <> 'F' union all
      select a, 5, k, pri, false from orders_of union all select a, 5, k, '', false from orders_of)"""


def order_tables(t):
    """Five result tables for every customer: orders, closed ones in other words, a line of counts, open ones with
    their date, and priorities next to an empty column."""
    sql = "with " + _ORDER_CELLS.format(orders="{orders}", text="string").strip() + " select * from result_cells"
    return t.spark.sql(sql, orders=t.orders).select(
        F.col("a").alias("answer_id"), F.col("t").alias("table_no"), F.col("r").alias("row_no"), F.col("v").alias("value"),
        F.col("num").alias("numeric"))


@query("table_containment", "with " + _ORDER_CELLS.format(orders="orders", text="varchar").strip() + """,
    cells as (select a, t, r, num, trim(regexp_replace(lower(v), '[^a-z0-9.]+', ' ', 'g')) as v from result_cells),
    rws as (select a, t, r, bool_and(num) as num, coalesce(list(v) filter (where v <> ''), []) as cs from cells group by a, t, r),
    sz as (select a, t, count(*) as n, bool_and(num) as num from rws group by a, t),
    hit as (select distinct x.a, x.t, x.r, b.t as bt from rws x join rws b on b.a = x.a and b.t <> x.t and len(x.cs) > 0
      and len(list_filter(x.cs, lambda c: list_contains(b.cs, c) or (length(c) > 3 and len(list_filter(b.cs, lambda y: contains(y, c))) > 0)))
        >= 0.9 * len(x.cs)),
    hn as (select a, t, bt, count(*) as n from hit group by 1, 2, 3),
    em as (select a, t, count(*) as n from rws where len(cs) = 0 group by a, t),
    cv as (select p.a, p.t, q.t as bt from sz p join sz q on q.a = p.a and q.t <> p.t left join em on em.a = p.a and em.t = p.t
      left join hn on hn.a = p.a and hn.t = p.t and hn.bt = q.t
      where p.n <= q.n and coalesce(hn.n, 0) + coalesce(em.n, 0) >= 0.95 * p.n),
    k1 as (select sz.*, not exists (select 1 from cv x where x.a = sz.a and x.t = sz.t
      and (x.bt > x.t or not exists (select 1 from cv y where y.a = x.a and y.t = x.bt and y.bt = x.t))) as k from sz),
    lf as (select a, count(*) filter (where k) as n, count(*) filter (where k and not (n = 1 and num)) as rest from k1 group by a)
    select k1.a as answer_id, t as table_no, k and (not (k1.n = 1 and num) or lf.n <= 1 or rest = 0) as kept from k1 join lf using (a)""")
def table_containment(t):
    return contained_tables(order_tables(t), coverage=full_coverage)


@query("source_links", """
    with m as (select distinct l.id as answer_id, trim(unnest(regexp_extract_all(answer, '\\*\\*(.+?)\\*\\*', 1))) as name from log l where answer is not null
      union select e.event_id, c_name from events e join customer on c_custkey = e.user_id where event_type <> 'error'),
    d as (select deal, url, status, row_number() over (partition by deal order by created_time desc, id) as n from deals),
    j as (select answer_id, name, url, status from m join d on d.deal = m.name and d.n = 1)
    from j""")
def source_links_query(t):
    answers = t.log.filter("answer is not null").select(F.col("id").alias("answer_id"), "answer")
    cells = t.events.filter("event_type <> 'error'").join(t.customer, F.col("c_custkey") == F.col("user_id")).select(
        F.col("event_id").alias("answer_id"), F.lit(1).alias("row_no"), F.col("c_name").alias("value"))
    return source_links(mentioned_names(answers, cells), t.deals)


_CACHE = r"""
    k as (select id, created_at, answer, error, rating, sha256(trim(regexp_replace(regexp_replace(lower(question), '\s+', ' ', 'g'), '[\s?.!]+$', '')) || chr(10) || model) as key from log),
    c as (select key, answer, created_at, 0 as hits from (select *, row_number() over (partition by key order by created_at desc, answer) as n
      from k where answer is not null) where n = 1)"""


def _keyed(t):
    return t.log.withColumn("key", request_key("question", "model"))


def _cache(t):
    empty = _keyed(t).limit(0).select("key", "answer", "created_at", F.lit(0).cast("bigint").alias("hits"))
    rows = _keyed(t).select("key", "answer", "created_at", F.col("answer").isNotNull().alias("verified"))
    none = t.log.limit(0).select("answer")
    return cache_update(empty, rows, none)


@query("answer_cache", f"with {_CACHE.strip()}" + """
    select k.id, k.key, c.answer as cached_answer, c.answer is not null as cached from k
    left join (select * from c where created_at > timestamp '2024-01-31' - interval 14 day) c on c.key = k.key""")
def answer_cache(t):
    served, _ = cache_lookup(_keyed(t).select("id", "key"), _cache(t), as_of())
    return served.select("id", "key", "cached_answer", "cached")


@query("answer_cache_hits", f"with {_CACHE.strip()}" + """
    select c.key, c.answer, case when c.created_at > timestamp '2024-01-31' - interval 14 day then (select count(*) from k where k.key = c.key) else 0 end as hits
    from c where c.answer not in (select answer from log where rating = -1 and answer is not null)""")
def answer_cache_hits(t):
    _, counted = cache_lookup(_keyed(t).select("id", "key"), _cache(t), as_of())
    down = t.log.filter("rating = -1 and answer is not null").select("answer")
    empty = _keyed(t).limit(0).select("key", "answer", "created_at", F.lit(True).alias("verified"))
    return cache_update(counted, empty, down).select("key", "answer", "hits")
