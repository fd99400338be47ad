"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm import (
    byte_bpe, cover_windows, decontaminate, line_runs, phrase_graph, pivotal_grams, quality, recurrent_lm, simhash,
    suffix_dedup, token_counts, url_filter, warc)
from dealweave.llm.common import shared_folder

QUERIES, CHECKS = {}, {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, folder):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_token_counts")
def op2(spark, folder):
    """Words and greedy word pieces of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


_REPEATS_CHECK = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
pieces as (select doc_id, s, x[2 * s + 1:2 * s + 1398] as piece
           from (select doc_id, x, unnest(range(0, length(x) // 2, 500)) as s from d)),
strings as (select doc_id, s + p as p, md5(piece[2 * p - 1:2 * p + 398]) as h
            from (select doc_id, s, piece, unnest(range(1, least(501, length(piece) // 2 - 198))) as p from pieces)),
twice as (select doc_id, p from strings where h in (select h from strings group by h having count(*) > 1)),
runs as (select doc_id, p, count(*) filter (fresh) over (partition by doc_id order by p) as run
         from (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > 200, true) as fresh from twice)),
spans as (select doc_id, run, min(p) as a, max(p) + 200 as b from runs group by doc_id, run),
gaps as (select doc_id, a, lag(b, 1, 1) over (partition by doc_id order by a) as from_, b from spans),
ends as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last_,
                string_agg(x[2 * from_ - 1:2 * a - 2], '' order by a) as head
         from gaps join d using (doc_id) group by doc_id)
select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(concat(coalesce(head, ''), x[2 * coalesce(last_, 1) - 1:]))) as kept_sha256
from d left join ends using (doc_id)"""


@query("op3_suffix_dedup", _REPEATS_CHECK)
def op3(spark, folder):
    """Bytes of every document removed as repeats of 200 bytes, and the digest of the rest."""
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_quality_rules")
def op4(spark, folder):
    """Word and repetition counts of every document, and whether the fertility bands keep it."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return quality.verdicts(quality.measures(docs, keep=["doc_id", "lang"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy")


RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]

_URL_PARTS = """
    select page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path
    from (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as host
          from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
                from pages))"""

_JUDGED_URLS = f"""
with parts as (
    select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path
    from ({_URL_PARTS})),
fits as (
    select *, case when concat('.', host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                   when concat('.', host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                   when concat('.', host) like '%.org' and path like '/fr/%' then 'org/fr/'
                   when concat('.', host) like '%.net' and path like '/%' then 'net/' end as rule,
           case when host = '' then '' else concat(regexp_replace(host, '^(www|m|blog)[.]', ''),
                                                   regexp_replace(path, '([.]html)?/*$', '')) end as key
    from parts),
spread as (select key from fits where key <> '' group by key having count(*) > 1)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when key in (select key from spread) then 'block' else 'allow' end as verdict
from fits"""


@query("op5_url_filters", _JUDGED_URLS)
def op5(spark, folder):
    """Rule and verdict of every page's URL. Listed are the canonical addresses that more than one page has."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, path = url_filter.url_parts(F.col("url"))
    listed = (pages.select(url_filter.canonical(host, path).alias("key")).where("key <> ''")
              .groupBy("key").count().where("count > 1").select("key"))
    return url_filter.judge(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


_LINES_CHECK = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (
    select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as key
    from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10),
judged as (select k.*, c.key is not null as common from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (common) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not common), '')) as kept_sha256
from judged group by doc_id"""


@query("op6_line_dedup", _LINES_CHECK)
def op6(spark, folder):
    """Line counts of every document, and the digest of what is left without lines of ten documents or more."""
    kept = line_runs.drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_WARC_CHECK = """
with bodies as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages),
firsts as (select *, min(page_id) over (partition by payload_digest) as first from bodies)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from firsts"""


@query("op7_warc_revisits", _WARC_CHECK)
def op7(spark, folder):
    """Every page as read back from the deduplicated archives."""
    archives = shared_folder(spark)
    warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    return warc.read_resolved(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORD_LIST = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_BENCHMARK_CHECK = f"""
with d as (select doc_id, {_WORD_LIST} as words from documents),
b as (select item_id, {_WORD_LIST} as words from benchmark),
sized as (select *, least(13, len(words)) as size from b where len(words) > 0),
windows as (
    select item_id, size, array_to_string(list_slice(words, j, j + size - 1), ' ') as w
    from (select *, unnest(range(1, len(words) - size + 2)) as j from sized)),
places as (select doc_id, words, unnest(range(1, len(words) + 1)) as p from d),
found as (
    select distinct doc_id, p, z.size, item_id
    from (select doc_id, p, s.size, array_to_string(list_slice(words, p, p + s.size - 1), ' ') as w
          from places, (select distinct size from windows) s where p + s.size - 1 <= len(words)) z
    join windows using (size, w)),
hit as (select doc_id, count(distinct pos) as n_hit
        from (select doc_id, unnest(range(p, p + size)) as pos from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join hit using (doc_id) left join named using (doc_id)"""


@query("op8_decontamination", _BENCHMARK_CHECK)
def op8(spark, folder):
    """Benchmark words and items found in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(decontaminate.matches(docs, table(spark, folder, "benchmark"), keep=["doc_id"]))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), "contaminated")


@query("op9_recurrent_lm")
def op9(spark, folder):
    """Unigram and recurrent model scores of every document."""
    return recurrent_lm.scores(table(spark, folder, "documents"))


@query("op10_byte_bpe")
def op10(spark, folder):
    """Token count and digests of ids and decoded text of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.encode_texts(docs, keep=["doc_id"], ids=False)


_WINDOWS_CHECK = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 18)) as p from d where len(words) >= 20),
windows as (select doc_id, p, md5(array_to_string(list_slice(words, p, p + 19), ' ')) as h from places),
ranked as (select doc_id, p, rank() over (partition by h order by doc_id, p) as nth from windows),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as pos from ranked where nth > 1),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
left_over as (select e.doc_id, string_agg(word, ' ' order by e.pos) as kept
              from each e left join gone g on e.doc_id = g.doc_id and e.pos = g.pos where g.pos is null group by e.doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join removed using (doc_id) left join left_over using (doc_id)"""


@query("op11_cover_windows", _WINDOWS_CHECK)
def op11(spark, folder):
    """Words of every document removed as repeats of earlier 20-word windows, and the digest of the rest."""
    kept = cover_windows.remove_windows(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_spelling_variants")
def op12(spark, folder):
    """Near words, form and root of every frequent word."""
    return pivotal_grams.variants(table(spark, folder, "documents"))


_PHRASES_CHECK = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
lists as (select lang, row_number() over () as piece_no, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
totals as (select lang, sum(len(words))::bigint as n from lists group by lang),
each as (select lang, piece_no, unnest(words) as w, generate_subscripts(words, 1) as p from lists),
ahead as (select lang, w, lead(w, 1) over x as w2, lead(w, 2) over x as w3, lead(w, 3) over x as w4
          from each window x as (partition by piece_no order by p)),
runs as (
    select lang, 1 as size, w as phrase from ahead
    union all select lang, 2, concat(w, ' ', w2) from ahead where w2 is not null
    union all select lang, 3, concat(w, ' ', w2, ' ', w3) from ahead where w3 is not null
    union all select lang, 4, concat(w, ' ', w2, ' ', w3, ' ', w4) from ahead where w4 is not null),
f as (select lang, size, phrase, count(*) as c from runs group by all having count(*) >= 30),
cand as (select lang, size, phrase, c as a, string_split(phrase, ' ') as words from f where size >= 2),
cuts as (
    select x.lang, x.size, x.phrase, x.words, x.a, k, l.c as l, r.c as r, (2000000 * x.a::hugeint) // (l.c + r.c) as score
    from cand x join (select unnest([1, 2, 3]) as k) on k < x.size
    join f l on l.lang = x.lang and l.phrase = array_to_string(list_slice(x.words, 1, k), ' ')
    join f r on r.lang = x.lang and r.phrase = array_to_string(list_slice(x.words, k + 1, x.size), ' ')),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_runs as (
    select lang, c, array_to_string(list_slice(string_split(phrase, ' '), p, p + s - 1), ' ') as phrase
    from (select lang, phrase, c, s, unnest(range(1, size - s + 2)) as p
          from f, (select unnest([2, 3]) as s) where s < size)),
covers as (select lang, phrase, max(c) as longer from inner_runs group by lang, phrase),
kept as (select w.* from weakest w left join covers v using (lang, phrase) where not coalesce(100 * longer >= 80 * a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000"""


@query("op13_phrase_graph", _PHRASES_CHECK)
def op13(spark, folder):
    """The strongest phrases of each language with their weakest cut."""
    return phrase_graph.collocations(table(spark, folder, "documents"))
