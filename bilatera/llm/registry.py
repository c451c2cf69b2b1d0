"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import TIDY

QUERIES: dict = {}
SQL: dict[str, str] = {}


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded in bytes, so a Python worker never holds many long documents; finished shuffles go early."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set(TIDY, "true")


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            modest_batches(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_suffix_array_dedup")
def _(spark, sf):
    from .substring_suffix import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_sum_of_squares_packing")
def _(spark, sf):
    from .packing import pack

    return pack(table(spark, sf, "documents"))


@query("op8_relative_lempel_ziv")
def _(spark, sf):
    from .substring_rlz import remove_known

    return remove_known(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_kneser_ney_quality")
def _(spark, sf):
    from .quality import judge

    return judge(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "perplexity", "low", "high", "word_perplexity", "word_low", "word_high", "trusted", "kept")


@query("op6_nearest_centroid_language")
def _(spark, sf):
    from .language import fit, predict

    docs = table(spark, sf, "documents")
    return predict(docs, fit(docs))


#: Target shares of the mixing query.
MIX = {"clean": 0.90, "toxic": 0.05, "junk": 0.05}


@query("op10_soft_membership_mixing")
def _(spark, sf):
    from .mixing import mix

    rated, info = mix(table(spark, sf, "documents"), table(spark, sf, "labels"), MIX)
    shares = [F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(info["domains"])]
    return rated.select("doc_id", "tokens", *shares, "rate", "copies")


@query("op1_ngram_jaccard_join")
def _(spark, sf):
    from .jaccard import join

    return join(table(spark, sf, "documents")).select("doc_id", "class_id", "component_id", "n_links", "kept")


#: Brute force over the same rows, in doubles, components in order.
VECTORS = """
v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


@query("op3_rotated_one_bit_codes", f"""
with {VECTORS},
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c
      on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""")
def _(spark, sf):
    from .ann import search

    return search(table(spark, sf, "embeddings"))


@query("op9_euclidean_p_stable_dedup", f"""
with recursive {VECTORS},
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) s from v where label is not null),
l as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r as (select vec_id a, vec_id b from n union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) component_id from r group by a),
k as (select a, count(*) n_links from l group by a)
select e.vec_id, e.label::bigint as label, coalesce(n_links, 0)::bigint n_links, coalesce(component_id, e.vec_id) component_id,
       coalesce(e.vec_id = coalesce(component_id, e.vec_id), true) kept
from embeddings e left join c on c.a = e.vec_id left join k on k.a = e.vec_id""")
def _(spark, sf):
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "embeddings"))


@query("op7_line_set_similarity", """
with l as (
    select doc_id, i - 1 line, list_filter(string_split_regex(lines[i], '[ \\t\\x0B\\f\\r]+'), lambda w: w <> '') w
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents), unnest(range(1, len(lines) + 1)) t(i)),
s as (select doc_id, line, list_sort(list_distinct(w)) w
      from l where len(w) > 0),
c as (select w, len(w) n, min((doc_id, line)) f, row_number() over () id from s group by w),
o as (select t, count(*) oc from (select unnest(w) t from c) group by t),
p as (select id, n, f, u.t, row_number() over (partition by id order by oc, u.t) k
      from (select id, n, f, unnest(w) t from c) u join o using (t)),
x as (select * from p where k <= n - ceil(0.8 * n - 1e-9) + 1),
pairs as (select distinct a.id a, b.id b from x a join x b on a.t = b.t and b.f < a.f and b.n >= 0.8 * a.n and a.n >= 0.8 * b.n),
g as (select distinct a.id from pairs join c a on a.id = pairs.a join c b on b.id = pairs.b
      where len(list_intersect(a.w, b.w)) / (a.n + b.n - len(list_intersect(a.w, b.w))) >= 0.8),
r as (select s.doc_id, s.line from s join c on c.w = s.w where c.f <> (s.doc_id, s.line) or c.id in (select id from g))
select d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint n_lines, coalesce(len(r.removed), 0)::bigint n_removed,
       coalesce(r.removed, []::int[]) removed
from documents d left join (select doc_id, list(line::int order by line) removed from r group by doc_id) r on r.doc_id = d.doc_id""")
def _(spark, sf):
    from .line_dedup import report

    return report(table(spark, sf, "documents"))


#: Rules of the url query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op12_url_hash_prefix_rules", """
with rules(rule_host, rule_path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r as (select page_id, row_number() over () id, case when contains(url, '://') then substring(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, translate(regexp_extract(rest, '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host from r),
f as (select id, rule_host || rule_path rule, verdict, row_number() over (partition by id order by length(rule_host || rule_path) desc) k
      from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join (select * from f where k = 1) f on f.id = p.id""")
def _(spark, sf):
    from .url_rules import judge

    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r)]) for r in URL_RULES])
    rules = spark.range(1).select(F.inline(each))
    return judge(table(spark, sf, "pages"), rules)


#: Levels and siblings from recursive grouping; the checksum bit by bit from the polynomial of the common CRC-32.
@query("op11_postorder_merkle_manifest", """
with recursive t as (select list_transform(range(256), lambda x: list_reduce([x::bigint] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) t),
d as (select row_number() over () id, doc_id, source, lang, n_chars::varchar n_chars, text, doc_id::varchar k from documents),
c as (select d.*, coalesce(xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::bigint),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0, false) even from d, t),
p as (select *, coalesce(octet_length(k::blob) || ':' || k, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(n_chars::blob) || ':' || n_chars, '-') head,
        case when even then replace(text, chr(10), '') else text end text2 from c),
l as (select id, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf,
        sha256(head || coalesce(octet_length(encode(text2)) || ':' || text2, '-')) changed from p),
o as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i from l),
a as (select source, 0 lev, i, leaf h from o
      union all
      select source, lev + 1, g, sha256(string_agg(h, '' order by i))
      from (select source, lev, i, i // 3 g, h, count(*) over (partition by source) n from a) where n > 1 group by source, lev, g),
s as (select source, max_by(h, lev) subroot, max(lev) top from a group by source),
so as (select *, row_number() over (order by source nulls first) - 1 j from s),
b as (select 0 lev, j i, subroot h from so
      union all
      select lev + 1, g, sha256(string_agg(h, '' order by i)) from (select lev, i, i // 3 g, h, count(*) over () n from b) where n > 1 group by lev, g),
w as (select max_by(h, lev) root, max(lev) top from b),
-- for every node below a root: the digests left and right of it within its run
ab as (select source, lev, i, coalesce(string_agg(h, '') over (partition by source, lev, i // 3 order by i rows between unbounded preceding and 1 preceding), '') lt,
        coalesce(string_agg(h, '') over (partition by source, lev, i // 3 order by i rows between 1 following and unbounded following), '') rt from a),
bb as (select lev, i, coalesce(string_agg(h, '') over (partition by lev, i // 3 order by i rows between unbounded preceding and 1 preceding), '') lt,
        coalesce(string_agg(h, '') over (partition by lev, i // 3 order by i rows between 1 following and unbounded following), '') rt from b),
e as (select o.id, lev, lt, rt from o join so on o.source is not distinct from so.source
        join ab on ab.source is not distinct from o.source and ab.lev < so.top and ab.i = o.i // (3 ** lev)::bigint
      union all
      select o.id, so.top + bb.lev, lt, rt from o join so on o.source is not distinct from so.source join w on true
        join bb on bb.lev < w.top and bb.i = so.j // (3 ** bb.lev)::bigint),
f as (select id, sha256(string_agg(lt || rt, '' order by lev)) proof_sha256, list({l: lt, r: rt} order by lev) steps from e group by id),
x as (select o.doc_id, o.leaf, so.subroot, w.root, coalesce(proof_sha256, sha256('')) proof_sha256,
        list_reduce([{l: '', r: changed}] || coalesce(steps, []), lambda acc, st: {l: '', r: sha256(st.l || acc.r || st.r)}).r folded_root
      from o join so on o.source is not distinct from so.source join w on true left join f on f.id = o.id)
select *, folded_root = root verified from x""")
def _(spark, sf):
    from .manifest import without_line_breaks

    return without_line_breaks(table(spark, sf, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_era_collocations", """
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') w from p),
n as (select lang, sum(len(w))::bigint n from w group by lang),
c as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f from w, (select unnest(range(1, 5)) k) s, unnest(range(1, len(w) - k + 2)) t(i)
      group by all having count(*) >= 30),
l as (select lang, k, phrase, f, string_split(phrase, ' ') ws from c where k > 1),
inner_ as (select lang, array_to_string(ws[i:i + m - 1], ' ') phrase, max(f) longer from l, (select unnest(range(2, 4)) m) s, unnest(range(1, k - m + 2)) t(i)
      where m < k group by 1, 2),
cuts as (select l.lang, l.phrase, l.f a, j, h.f l, r.f r, (2000000::hugeint * l.f) // (h.f + r.f) score from l, unnest(range(1, l.k)) t(j)
      join c h on h.lang = l.lang and h.phrase = array_to_string(l.ws[1:j], ' ')
      join c r on r.lang = l.lang and r.phrase = array_to_string(l.ws[j + 1:], ' ')),
one as (select *, row_number() over (partition by lang, phrase order by score, j) q from cuts),
kept as (select o.* from one o left join inner_ i on i.lang = o.lang and i.phrase = o.phrase where q = 1 and (longer is null or 100::hugeint * longer < 80::hugeint * a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select ranked.lang, rank, phrase, a, l, r, n, score::bigint score from ranked join n on n.lang = ranked.lang where rank <= 2000""")
def _(spark, sf):
    from .collocations import mine

    return mine(table(spark, sf, "documents"))
