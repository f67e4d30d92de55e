"""The operators on the given tables, and SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landtrace.llm.chunkdedup import dedup_passages
from landtrace.llm.common import shared_folder
from landtrace.llm.counts import TokenLedger, copies, token_counts
from landtrace.llm.decontam import contamination
from landtrace.llm.licenses import TEMPLATES, scan_licences
from landtrace.llm.linededup import line_report
from landtrace.llm.packing import pack
from landtrace.llm.quality import host_quality
from landtrace.llm.resampling import resample
from landtrace.llm.setjoin import jaccard_components
from landtrace.llm.sharding import kd_shards
from landtrace.llm.simhash import near_duplicates
from landtrace.llm.suffixdedup import dedup_substrings
from landtrace.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUALITY_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
two as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from two) group by 1),
f as (select w.doc_id, source, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(l) as n_lines,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
      from w left join rep using (doc_id)),
r as (select *, n_words < 20 as short, 100 * n_repeat_words > 30 * n_words as repeated,
        10 * n_symbols > word_chars as symbols, 100 * n_dup_lines > 30 * n_lines as dup_lines from f),
h as (unpivot (select source, count(*)::double as n, sum(short::int)::double as short, sum(repeated::int)::double as repeated,
        sum(symbols::int)::double as symbols, sum(dup_lines::int)::double as dup_lines from r group by 1)
      on short, repeated, symbols, dup_lines into name rule value f),
m as (select rule, sum(f) / sum(n) as mean, sum(f * f / n) as squares, sum(n) as n, count(*) as hosts from h group by 1),
s as (select rule, mean, case when mean * (1 - mean) <= 0 or hosts < 2 then 0 when n / hosts <= 1 then 1 else
        (1 - least(greatest((squares / n - mean * mean - mean * (1 - mean) / (n / hosts)) / (mean * (1 - mean) * (1 - 1 / (n / hosts))), 1e-6), 1))
        / least(greatest((squares / n - mean * mean - mean * (1 - mean) / (n / hosts)) / (mean * (1 - mean) * (1 - 1 / (n / hosts))), 1e-6), 1) end as strength from m),
b as (select source, bool_or((f + strength * mean) / (h.n + strength)
        > least(0.5, greatest(0.25, mean + 3 * sqrt(greatest(mean * (1 - mean), 0) / (strength + 1))))) as bad
      from h join s using (rule) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short or repeated) as base_failed,
  not (short or repeated) and not bad as kept
from r join b on r.source is not distinct from b.source
"""


@query("op10_host_quality", QUALITY_SQL)
def _(spark, sf_dir):
    return host_quality(read(spark, sf_dir, "documents"))


LINES_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
l as (select doc_id, unnest(l) as line, unnest(range(len(l))) as i from d),
u as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as worded, greatest(0, sum(regexp_matches(line, '[^\x20\x09-\x0D]')::int)
        over (partition by doc_id order by i) - 1)::bigint as k from l),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from u where worded),
b as (select *, (h + 31 * coalesce(lag(h) over (partition by doc_id order by k), 0)) % 4 <> 0 as ends from h),
w as (select doc_id, list(line order by k) as w from h group by 1),
e as (select doc_id, k, least(coalesce(min(case when ends then k end) over (partition by doc_id order by k
        rows between 1 following and 7 following), k + 7), len(w) - 1) as e, w from b join w using (doc_id)),
o as (select doc_id, k, e, row_number() over (partition by list_slice(w, k + 1, e + 1) order by doc_id, k) > 1 as gone from e where e > k),
c as (select distinct doc_id, unnest(range(k, e + 1)) as k from o where gone),
t as (select doc_id, count(*) as n_lines, count(c.k) as n_removed_lines,
        coalesce(string_agg(line, chr(10) order by i) filter (c.k is null), '') as text from u left join c using (doc_id, k) group by 1)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed_lines, 0) as n_removed_lines, t.text
from documents left join t using (doc_id)
"""


@query("op1_line_dedup", LINES_SQL)
def _(spark, sf_dir):
    return line_report(read(spark, sf_dir, "documents"))


@query("op2_simhash_near_dedup")
def _(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op4_chunk_dedup")
def _(spark, sf_dir):
    return dedup_passages(read(spark, sf_dir, "documents"))


LEAKS_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, g from (
        select item_id, list_slice(w, i, i + 9) as g from (select item_id, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
        union all select item_id, w from b where len(w) between 1 and 9)),
dw as (select doc_id, i, n, list_slice(w, i, i + n - 1) as g from (
        select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct len(g) as n from bw) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dw join bw using (g)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
          from (select distinct doc_id, item_id::varchar as item_id from hits where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@query("op5_benchmark_decontamination", LEAKS_SQL)
def _(spark, sf_dir):
    rows = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


@query("op6_token_counts")
def _(spark, sf_dir):
    """All documents are inserted; then copies are deleted and the others revised to count an end id.

    The first batch is sent twice; the second time changes nothing. The result is the totals after each batch, so
    those of batch 1 are the counts of the whole table.
    """
    folder = shared_folder(spark, f"ledger-{uuid.uuid4().hex}")
    counted = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    counted.write.parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted").withColumn("tokenizer", F.lit("word_bpe_49k"))
    ledger = TokenLedger(spark, folder)
    inserts = counted.withColumns({"op": F.lit("insert"), "seq": F.lit(0)})
    for _ in range(2):
        ledger.commit(1, inserts)
    revised = counted.withColumns({"op": F.lit("revise"), "seq": F.lit(0), "n_tokens": F.col("n_tokens") + 1})
    deleted = copies(counted).withColumns({"op": F.lit("delete"), "seq": F.lit(1)})
    ledger.commit(2, revised.unionByName(deleted))
    return ledger.history()


def document_path() -> Column:
    """Short documents lie in their source and language, the others by thousands of ids below."""
    folder = F.when(F.col("n_chars") < 500, F.lit("")).otherwise(F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/")))
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.col("doc_id").cast("string"), F.lit(".txt"))


def _words_sql(text: str) -> str:
    return f"""list_filter(string_split_regex(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


_NOTICES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
LICENCES_SQL = f"""
with t as (from (values {_NOTICES}) v(k, name, text)),
tw as (select k, name, w, count(*) as tf from (select k, name, unnest({_words_sql('text')}) as w from t) group by all),
d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l,
        concat(source, '/', lang, '/', case when n_chars < 500 then '' else concat(doc_id // 1000, '/') end, doc_id, '.txt') as path
      from documents),
df as (select w, count(*) as n from (select unnest(list_distinct({_words_sql('text')})) as w from d)
       where w in (select w from tw) group by 1),
idf as (select w, ln((1 + (select count(*) from d))::double / (1 + coalesce(n, 0))) + 1 as idf
        from (select distinct w from tw) left join df using (w)),
tv as (select k, name, w, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by k)) as x from tw join idf using (w)),
u as (select doc_id, unnest(l) as line, unnest(range(len(l))) as unit from d
      union all select doc_id, text, len(l) from d where len(l) > 1),
uw as (select doc_id, unit, w, count(*) as tf from (select doc_id, unit, unnest({_words_sql('line')}) as w from u) group by all),
un as (select doc_id, unit, sqrt(sum(pow(tf * coalesce(idf, (select ln(1 + count(*)) + 1 from d)), 2))) as norm
       from uw left join idf using (w) group by all),
s as (select doc_id, unit, name, round(sum(tf * idf * x) / any_value(norm), 9) as similarity
      from uw join idf using (w) join tv using (w) join un using (doc_id, unit) group by doc_id, unit, k, name),
own as (select doc_id, max(row(similarity, name)) as best, bool_or(unit = 0) as opens from s where similarity >= 0.8 group by 1),
f as (select doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, best[2] as own, best[1] as similarity, opens
      from d left join own using (doc_id)),
g as (select dir, min(row(path, own))[2] as licence from f where opens group by 1),
near as (select f.dir, g.dir as origin, g.licence from (select distinct dir from f) f
         join g on f.dir = g.dir or g.dir = '' or starts_with(f.dir, concat(g.dir, '/'))
         qualify row_number() over (partition by f.dir order by length(g.dir) desc) = 1)
select doc_id, path, coalesce(own, licence) as licence,
  case when own is not null then 'own' when licence is not null then 'inherited' end as origin,
  case when own is null then near.origin end as inherited_from, round(similarity, 6) as similarity
from f left join near using (dir)
"""


@query("op7_license_scan", LICENCES_SQL)
def _(spark, sf_dir):
    return scan_licences(read(spark, sf_dir, "documents"), document_path())


SUBSTRINGS_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g
      from (select doc_id, h, unnest(range(length(h) // 2 - 99)) as i from d)),
later as (select doc_id, i from w qualify row_number() over (partition by g order by doc_id, i) > 1),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from (
    select *, sum(new) over (partition by doc_id order by i) as run from (
      select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from later))
  group by doc_id, run),
rest as (select doc_id, b as a, lead(a) over (partition by doc_id order by a) as b from runs
         union all select doc_id, 0, min(a) from runs group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * rest.a + 1, 2 * (coalesce(rest.b, length(h) // 2) - rest.a)), '' order by rest.a) as h
         from rest join d using (doc_id) group by 1),
n as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from runs group by 1)
select doc_id, length(d.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""


@query("op8_suffix_dedup", SUBSTRINGS_SQL)
def _(spark, sf_dir):
    rows = dedup_substrings(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op9_kd_shards")
def _(spark, sf_dir):
    rows = kd_shards(read(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op3_best_fit_packing")
def _(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))

def _crc_sql() -> str:
    """CRC-32 of the distinct words of ``words`` by its rule: a table of 256 remainders, then one step per byte."""
    return """crc as (select list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)),
kinds as (select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
        lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket
      from (select w from dw union select w from bw) cross join crc)"""


RESAMPLING_SQL = f"""
with d as (select doc_id, {_words_sql("coalesce(text, '')")} as w from documents),
dw as (select doc_id, unnest(w) as w from d),
bw as (select unnest({_words_sql("coalesce(text, '')")}) as w from benchmark),
{_crc_sql()},
s as (select bucket, count(*) as s from dw join kinds using (w) group by 1),
t as (select bucket, count(*) as t from bw join kinds using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (select count(*) + 10000 from dw)::double
        / ((coalesce(s, 0) + 1)::double * (select count(*) + 10000 from bw)::double)))::bigint as g
      from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)),
f as (select doc_id, count(*) as n, floor(sum(g) / count(*))::bigint as weight from dw join kinds using (w) join g using (bucket) group by 1),
a as (select doc_id, len(w) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
      from d left join f using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from a where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) * 10 // 100 from r) then rank end as rank
from a left join r using (doc_id)
"""


@query("op13_importance_resampling", RESAMPLING_SQL)
def _(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), share=(10, 100))


@query("op11_embedding_whitening")
def _(spark, sf_dir):
    rows = whiten(read(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


JACCARD_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end)) as s from d),
k as materialized (select s, min(doc_id) as k from s where len(s) > 0 group by 1),
e as materialized (select k, len(s) as n, unnest(s) as x from k),
p as materialized (select a.k as a, b.k as b from e a join e b on a.x = b.x and a.k < b.k and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
      group by a.k, b.k, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as materialized (select a, b from p union all select b, a from p),
r as (select a, a as root from l union select l.b, r.root from r join l on l.a = r.a)
select doc_id, len(s.s)::bigint as n_shingles, coalesce(c.root, k.k, doc_id) as component_id
from s left join k on s.s = k.s left join (select a, min(root) as root from r group by 1) c on c.a = k.k
"""


@query("op12_ngram_jaccard_join", JACCARD_SQL)
def _(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))
