"""The queries over the corpus operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import backoff, dac, gumbel, radix, recompress, rtree, suffixauto, toxcnn, urlalias, weaklabel


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark, sf_dir):
    import public_tokenizers

    # this tokenizer drops white space, so words can be encoded one by one
    return dac.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)


def op2_quality(spark, sf_dir):
    return weaklabel.quality(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return radix.exact_groups(_table(spark, sf_dir, "documents")).drop("uid")


def op4_subword_sampling(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return gumbel.sampled_digest(_table(spark, sf_dir, "documents"), model, k=2)


def op5_decontamination(spark, sf_dir):
    return suffixauto.digest(suffixauto.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_substring_dedup(spark, sf_dir):
    return recompress.digest(recompress.repeated_spans(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark, sf_dir):
    return toxcnn.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return urlalias.url_verdicts(_table(spark, sf_dir, "pages")).drop("component")


def op9_jaccard_join(spark, sf_dir):
    return rtree.near_components(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_lm_scoring(spark, sf_dir):
    return backoff.scores(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_quality, op3_exact_dedup, op4_subword_sampling, op5_decontamination, op6_substring_dedup, op7_toxicity, op8_url_filter, op9_jaccard_join, op10_lm_scoring)}

SQL = {
    "op3_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t from documents),
g as (select *, first_value(doc_id) over w keep_id, count(*) over (partition by t) group_size, row_number() over w = 1 kept
      from d window w as (partition by t order by n desc, doc_id))
select doc_id, keep_id, group_size, kept, sha256(t) text_sha256 from g""",
    "op5_decontamination": r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
dw as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from low),
iw as (select item_id::varchar item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') s
         from (select item, w, least(len(w), 10) k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from iw where len(w) > 0)),
sizes as (select distinct k from wins),
docwin as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s
           from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, sizes where len(w) >= k)),
hits as (select doc_id, i, docwin.k, item from docwin join wins using (s) where docwin.k = wins.k),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hits) group by 1),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join covered using (doc_id) left join named using (doc_id)""",
    "op8_url_filter": r"""
with recursive p as (select page_id, coalesce(url, '') u, html from pages),
b as (select page_id, html, translate(regexp_extract(u, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(u, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) path, regexp_extract(u, '^[\s\S]*?://[^/?#]*([^#]*)', 1) rest from p),
t as (select distinct host || rest a, host, path, replace(unnest(
        list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) ||
        list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1))), '&amp;', '&') link from b where html is not null),
w as (select a, host, path, link, regexp_extract(link, '^[^?#]*(\?[^#]*)', 1) q, regexp_extract(link, '^([^?#]*)', 1) way from t where link <> ''),
g as (select *, string_split(case when starts_with(way, '/') then way when path = '' then '/' || way else regexp_extract(path, '^(.*/)', 1) || way end, '/') s from w),
r as (select *, list_reduce(list_transform(s[2:], lambda x: [x]), lambda acc, x: case x[1] when '.' then acc when '..' then acc[:len(acc) - 1] else acc || x end, []::varchar[]) k from g),
f as (select a, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then 'http:' || link
      when starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') or host = '' then null
      when starts_with(link, '?') then 'http://' || host || path || q
      else 'http://' || host || '/' || array_to_string(k, '/') || case when s[-1] in ('.', '..') and len(k) > 0 then '/' else '' end || q end l from r),
e as (select a, translate(regexp_extract(l, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(l, '^[\s\S]*?://[^/?#]*([^#]*)', 1) z from f where l is not null),
two as (select a, z from e where a <> z and a <> '' and z <> '' union select z, a from e where a <> z and a <> '' and z <> ''),
reach as (select a, a z from two union select r.a, two.z from reach r join two on r.z = two.a),
rules as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) x(v, h, s)),
own as (select page_id, host, path, host || rest node, (select r.h || r.s from rules r where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.s) order by length(r.h || r.s) desc limit 1) rule from b),
alias as (select reach.a, max((r.v = 'allow')::int) al, max((r.v = 'block')::int) bl from reach join
      (select z, (select r.v from rules r where (regexp_extract(z, '^([^/?#]*)', 1) = r.h or ends_with(regexp_extract(z, '^([^/?#]*)', 1), '.' || r.h)) and starts_with(regexp_extract(z, '^[^/?#]*([^?#]*)', 1), r.s) order by length(r.h || r.s) desc limit 1) v
       from (select distinct z from reach)) r using (z) group by 1)
select page_id, host, path, rule, coalesce((select v from rules where h || s = rule), case when al = 1 then 'allow' when bl = 1 then 'block' end, 'allow') verdict
from own left join alias on own.node = alias.a""",
    "op6_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
firsts as (select s, min(doc_id) f from win group by s),
gone as (select doc_id, list(distinct p) g from (select doc_id, unnest(range(i, i + 13)) p from win join firsts using (s) where f < doc_id) group by doc_id),
k as (select doc_id, w, coalesce(g, []) g from d left join gone using (doc_id)),
kept as (select doc_id, string_agg(x, ' ' order by i) t from (select doc_id, g, unnest(w) x, generate_subscripts(w, 1) i from k) where not list_contains(g, i) group by doc_id)
select doc_id, len(w)::bigint n_words, len(g)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from k left join kept using (doc_id)""",
    "op9_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) i from d)),
n as (select doc_id, count(*) n from s group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) common from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 90 * (a.n + b.n - common)),
reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x),
least_ as (select x, min(y) c from reach group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) component_id from d left join n using (doc_id) left join least_ on d.doc_id = x""",
}
