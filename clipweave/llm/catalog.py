"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bwt_merge, codes, leaks, line_dedup, mixing, ngram_join, pieces, quality_rules, quotation, rans, suffix_tree, topk, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary ``name`` lies; every machine has these files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotation.threads(quotation.render(quotation.reply_order(_table(spark, sf_dir, "conversations"))))
    return out.withColumn("chat", F.sha2("chat", 256)).withColumnRenamed("chat", "chat_sha256")


def op2_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.remove_repeated_words(_table(spark, sf_dir, "documents"), width=50, kept=False)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op6_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_merge.remove_repeated_bytes(_table(spark, sf_dir, "documents"), width=50, kept=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_table(spark, sf_dir, "embeddings"), queries="vec_id % 50 = 0", k=5)


def op7_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_output(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), nbest=4)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "scores", "ids_crc32", "round_trip")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "rule")


MIX = {"fraction": 0.6, "max_epochs": 2, "domains": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "langs": {"en": 4, "de": 2, "fr": 2, "es": 2}, "seed": 11}


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"), **MIX)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = leaks.covered(F.col("spans"))
    names, n_items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("items").cast("long").alias("n_items")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), n_items, names, (hit > 0).alias("contaminated"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.vocabulary(_table(spark, sf_dir, "documents")))


_BLANK = r"[\x20\x09-\x0D]"


def _normal_sql(text: str) -> str:
    return f"translate(trim(regexp_replace({text}, '{_BLANK}+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_RUN = quotation.RUN
_OP1 = rf"""
with recursive m as (
  select row_number() over () as id, conv_id as c, turn as t, role, coalesce(text, '') as body, string_split(coalesce(text, ''), chr(10)) as ls from conversations
), line as (
  select id, c, t, pos, ls[pos] as line, regexp_extract(ls[pos], '{quotation.MARKS}') as marks from (select *, unnest(range(1, len(ls) + 1)) as pos from m)
), lev as (
  select *, length(marks) - length(replace(marks, '>', '')) as level from line
), nxt as (
  select *, coalesce(lead(level) over (partition by id order by pos), 0) as after, case when level = lag(level) over (partition by id order by pos) then 0 else 1 end as fresh from lev
), runs as (select *, sum(fresh) over (partition by id order by pos rows unbounded preceding) as run from nxt
), own0 as (
  select id, string_agg(line, chr(10) order by pos) filter (where level = 0 and not (regexp_matches(line, '{quotation.LEAD}') and after > 0)) as o from nxt group by id
), own as (
  select m.id, m.c, m.t, regexp_replace(coalesce(o, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') as own from m left join own0 on m.id = own0.id
), saying as (select *, list_filter(list_transform(string_split(own, chr(10)), lambda x: {_normal_sql("x")}), lambda x: x <> '') as said from own
), passage as (
  select * from (
    select id, c, t, level, run, min(pos) as pos, list_filter(list({_normal_sql("regexp_replace(line, '" + quotation.MARKS + "', '')")} order by pos), lambda x: x <> '') as said
    from runs where level > 0 group by id, c, t, level, run
  ) where len(said) > 0
), size as (select distinct c, len(said) as k from passage where len(said) <= {_RUN}
), long as (
  select p.id, p.level, p.run, min(s.t) as long from passage p join saying s on s.c = p.c and contains(chr(10) || array_to_string(s.said, chr(10)) || chr(10), chr(10) || array_to_string(p.said, chr(10)) || chr(10))
  where len(p.said) > {_RUN} group by p.id, p.level, p.run
), unit as (
  select c, t, {_normal_sql("u")} as u from (select c, t, own as u from own union all select c, t, unnest(regexp_split_to_array(own, '\n[\x20\x09-\x0D]*\n')) from own)
  union all select c, t, unnest(said) from saying
  union all select c, t, array_to_string(said[i:i + k - 1], ' ') from (select s.c, s.t, said, k, unnest(range(1, len(said) - k + 2)) as i from saying s join size on size.c = s.c where len(said) >= k)
), has as (select distinct c, t, u from unit where u <> ''
), origin as (select c, u, min(t) as origin from has group by c, u
), whole as (
  select p.*, case when least(o.origin, long) < p.t then least(o.origin, long) end as origin
  from passage p left join origin o on o.c = p.c and o.u = array_to_string(said, ' ') left join long on long.id = p.id and long.level = p.level and long.run = p.run
), vote as (
  select id, w.c, w.t, level, run, len(said) as n, o.origin as origin, count(*) as votes from (select *, unnest(said) as l from (select * exclude origin from whole where origin is null)) w
  join origin o on o.c = w.c and o.u = w.l where o.origin < w.t group by id, w.c, w.t, level, run, len(said), o.origin having 2 * count(*) >= len(said)
), most as (select id, level, run, arg_min(origin, (-votes, origin)) as most from vote group by id, level, run
), link as (select w.* exclude origin, coalesce(origin, most) as origin from whole w left join most using (id, level, run)
), told as (select id, count(*) as q, count(origin) as n from link group by id
), parent as (select c, t, arg_min(origin, (level, pos, origin)) as parent from link where origin is not null group by c, t
), up as (
  select c, t, parent as root, [parent, t] as path from parent
  union all select up.c, up.t, p.parent, [p.parent] || up.path from up join parent p on p.c = up.c and p.t = up.root
), top as (select c, t, min(root) as root, arg_max(path, len(path)) as path from up group by c, t
), turns as (
  select *, row_number() over (partition by c, root order by path) - 1 as place from (select distinct m.c, m.t, coalesce(root, m.t) as root, coalesce(path, [m.t]) as path from m left join top on top.c = m.c and top.t = m.t)
), msg as (
  select m.c, turns.root, turns.place, m.t, coalesce(parent.parent, -1) as parent, coalesce(told.q, 0) as q, coalesce(told.n, 0) as n, coalesce(m.role, '') as role, own.own,
         '<|' || coalesce(m.role, '') || '|>' || chr(10) || own.own || chr(10) as chat
  from m join own on own.id = m.id join turns on turns.c = m.c and turns.t = m.t left join told on told.id = m.id left join parent on parent.c = m.c and parent.t = m.t
)
select c as conv_id, root as root_turn, (place // 64)::bigint as part, count(*) as n_messages, string_agg(t::varchar, ',' order by place, role, own) as turns,
       string_agg(parent::varchar, ',' order by place, role, own) as parents, sum(q)::bigint as n_quotes, sum(n)::bigint as n_linked, sha256(string_agg(chat, '' order by place, role, own)) as chat_sha256
from msg where c is not null and t is not null group by 1, 2, 3
"""

_OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)
), least as (select s, min(doc_id) as m from win group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from win join least using (s) where m < doc_id
), word as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)
), kept as (
  select k.doc_id, count(g.p) as n_removed, coalesce(string_agg(k.word, ' ' order by k.p) filter (where g.p is null), '') as t
  from word k left join gone g on g.doc_id = k.doc_id and g.p = k.p group by k.doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept on d.doc_id = kept.doc_id
"""

_OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), win as (
  select doc_id, i, substring(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d where len(h) >= 100)
), least as (select s, min(doc_id) as m from win group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from win join least using (s) where m < doc_id
), byte as (select doc_id, p, substring(h, 2 * p + 1, 2) as b from (select doc_id, h, unnest(range(0, len(h) // 2)) as p from d)
), marked as (
  select k.doc_id, k.p, k.b, g.p is not null as gone, coalesce(lag(g.p is not null) over (partition by k.doc_id order by k.p), false) as before
  from byte k left join gone g on g.doc_id = k.doc_id and g.p = k.p
), kept as (
  select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where gone and not before) as n_spans, coalesce(string_agg(b, '' order by p) filter (where not gone), '') as t
  from marked group by doc_id
)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(t, ''))) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

_OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_OP5 = """
with lines as (
  select doc_id, source, pos, string_split(coalesce(text, ''), chr(10))[pos] as line
  from (select doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from documents where text is not null)
), spread as (
  select trim(line, ' ') as line from lines where trim(line, ' ') <> '' group by 1 having count(distinct source) >= 8
), kept as (
  select l.doc_id, count(*) as n_lines, count(s.line) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where s.line is null), '') as kept
  from lines l left join spread s on trim(l.line, ' ') = s.line group by l.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""

_OP8 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where text is not null
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by 1
), links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes na on na.doc_id = a.doc_id join sizes nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach as (
  select doc_id as x, doc_id as y from documents
  union select r.x, l.y from reach r join links l on r.y = l.x
), least as (select x, min(y) as c from reach group by x)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.c as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.x = d.doc_id
"""


def _share_sql(name: str, source: str, parent: str, key: str, out: str) -> str:
    """SQL of mixing.share as common table expressions."""
    over = f"partition by {parent} order by cap / w, {key}"
    return f"""{name}_level as (
  select *, (total - coalesce(sum(cap) over ({over} rows between unbounded preceding and 1 preceding), 0))::double
            / sum(w) over ({over} rows between current row and unbounded following) as lvl from {source} where w > 0
), {name} as (
  select *, (case when cap > lvl * w then floor(greatest(max(case when cap > lvl * w then lvl end) over (partition by {parent}), 0.0) * w) else cap end)::bigint as {out} from {name}_level
)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"(case {' '.join(f'when {column} = {k!r} then {v}' for k, v in weights.items())} else 1 end)::double"


_OP10 = rf"""
with d0 as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) % 4) as domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from documents
), d as (select * from d0 where n_tokens > 0
), leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all
), lev1 as (
  select domain, sum(tokens * {MIX["max_epochs"]})::bigint as cap, {_case("domain", MIX["domains"])} as w,
         (select floor(sum(tokens)::double * {MIX["fraction"]})::bigint from leaf) as total from leaf group by domain
), {_share_sql("s1", "lev1", "total", "domain", "b1")}, lev2 as (
  select l.domain, l.lang, sum(l.tokens * {MIX["max_epochs"]})::bigint as cap, {_case("l.lang", MIX["langs"])} as w, any_value(s1.b1) as total
  from leaf l join s1 on l.domain = s1.domain group by l.domain, l.lang
), {_share_sql("s2", "lev2", "domain", "lang", "b2")}, lev3 as (
  select l.domain, l.lang, l.source, l.tokens, l.tokens * {MIX["max_epochs"]} as cap, 1.0::double as w, s2.b2 as total from leaf l join s2 on l.domain = s2.domain and l.lang = s2.lang
), {_share_sql("s3", "lev3", "domain, lang", "source", "budget")}, placed as (
  select d.*, s3.budget // s3.tokens as epochs, s3.budget % s3.tokens as rest,
         md5('{MIX["seed"]}:' || (s3.budget // s3.tokens) || ':' || coalesce(d.doc_id::varchar, '')) as k
  from d join s3 on d.domain = s3.domain and d.lang = s3.lang and d.source = s3.source
), walked as (select *, sum(n_tokens) over (partition by domain, lang, source order by k range between unbounded preceding and current row) as upto from placed)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, (epochs + case when upto <= rest then 1 else 0 end)::bigint as copies
from walked where epochs + case when upto <= rest then 1 else 0 end > 0
"""


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written one after the other: distances of all entries, the nearest, and the next means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""dist{r} as (
  select row, b.part, entry, sum((b.x - e.x) * (b.x - e.x)) as d from bits b join book{r} e on e.part = b.part and e.pos = b.pos group by row, b.part, entry
), near{r} as materialized (select row, part, min(d) as d, arg_min(entry, (d, entry)) as entry from dist{r} group by row, part)""")
        if r < rounds:
            steps.append(f"""mean{r} as (
  select b.part, entry, b.pos, sum(x) as s, count(*) as n from bits b join near{r} c on c.row = b.row and c.part = b.part group by b.part, entry, b.pos
), book{r + 1} as materialized (
  select e.part, e.entry, e.pos, coalesce((s - ((s % n) + n) % n) // n, e.x)::bigint as x
  from book{r} e left join mean{r} m on m.part = e.part and m.entry = e.entry and m.pos = e.pos
)""")
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as row, vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), wide as (select (max(len(v)) + {parts - 1}) // {parts} as w from kept
), bits as materialized (
  select row, k // w as part, k % w as pos, floor(4096 * coalesce(v[k + 1], 0)::double)::bigint as x
  from (select *, unnest(range(0, {parts} * w)) as k from kept, wide)
), book0 as materialized (select part, row as entry, pos, x from bits where row < {entries}
), {", ".join(steps)}, named as (
  select k.vec_id, k.label, string_agg(printf('%02x', c.entry), '' order by c.part) as code, sum(c.d)::bigint as error
  from kept k join near{rounds} c on c.row = k.row group by k.row, k.vec_id, k.label
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256 from named
"""


_LEAK_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP12 = rf"""
with d as (select row_number() over () as row, doc_id, {_LEAK_WORDS} as w from documents
), i as (select item_id, {_LEAK_WORDS} as w from benchmark where text is not null
), strings as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as s
  from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as k from i where len(w) > 0)
), sizes as (select distinct size from strings
), places as (
  select row, k, size, array_to_string(w[k:k + size - 1], ' ') as s
  from (select row, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes where len(w) >= size)
), met as materialized (select row, k, p.size, item_id from places p join strings using (size, s)
), hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(k, k + size)) as p from met) group by row
), named as (
  select row, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct row, item_id::varchar as item from met where item_id is not null) group by row
)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row) left join named using (row)
"""

_OP13 = r"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t
), runs as (
  select coalesce(doc_id::varchar, '') || ':' as d,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w
  from documents where text is not null
), times as (select d, w, count(*) as n from runs group by d, w
), bytes as (
  select w, n, flatten(list_transform(string_split(d || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint]
    else [192 + unicode(c)::bigint // 64, 128 + unicode(c)::bigint % 64] end)) as b from times
), hashed as (
  select w, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) as h from bytes, crc
), slipped as (
  select case when h % 31 = 0 then substring(w, 1, (h % length(w))::int) || substring(w, (h % length(w))::int + 2) else w end as word, n from hashed
), words as materialized (select word, sum(n)::bigint as n from slipped where length(word) >= 7 group by word having sum(n) >= 2
), less as materialized (
  select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)
), near as materialized (
  select distinct word, other, n from (
    select a.word, b.word as other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union all select l.word, w.word, w.n from less l join words w on w.word = l.rest
    union all select l.rest, l.word, l.n from less l join words w on w.word = l.rest
  )
), best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as n from near group by word
), form as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.n >= 10 * w.n then other end as form, case when b.n >= 10 * w.n then b.n end as form_n
  from words w left join best b on b.word = w.word
), up as (
  select word, form as root, 1 as steps from form where form is not null
  union all select up.word, f.form, steps + 1 from up join form f on f.word = up.root where f.form is not null
), top as (select word, arg_max(root, steps) as root from up group by word)
select f.word, f.form, coalesce(t.root, f.word) as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from form f left join top t on t.word = f.word
"""

_ALL = (
    op1_quotation_linking, op2_suffix_tree_dedup, op6_bwt_merge_dedup, op3_sentencepiece_nbest, op4_exact_topk, op5_line_dedup, op7_rans_tokens,
    op8_ngram_jaccard_join, op9_quality_rules, op10_mix_sources, op11_vector_codes, op12_wu_manber_decontamination, op13_spelling_variants,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op1_quotation_linking": _OP1, "op2_suffix_tree_dedup": _OP2, "op4_exact_topk": _OP4, "op6_bwt_merge_dedup": _OP6, "op5_line_dedup": _OP5,
    "op8_ngram_jaccard_join": _OP8, "op10_mix_sources": _OP10, "op11_vector_codes": _op11_sql(), "op12_wu_manber_decontamination": _OP12,
    "op13_spelling_variants": _OP13,
}
