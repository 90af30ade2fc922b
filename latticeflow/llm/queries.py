"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, katz, language_id, near_dedup, quality_model, quality_rules, sentencepiece_nbest, substring_dedup, token_counts, warc
from .common import table


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def held(column: str, mod: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(mod))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.coalesce(held("doc_id", 4), F.lit(2))
    prototypes = language_id.fit(docs.filter(part != 2))
    return language_id.identify(docs, prototypes).select("doc_id", (F.coalesce(held("doc_id", 4), F.lit(2)) == 2).alias("held_out"), "lang_pred", "score")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False, levels=True)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), num=85)


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEVELS = [50 * 2**k for k in range(11)]
#: A window of twice the length is two windows side by side.
DOUBLED = ", ".join(f"h{2 * n} as (select a.doc_id, a.s, md5(a.h || b.h) h from h{n} a join h{n} b on a.doc_id = b.doc_id and b.s = a.s + {n})" for n in LEVELS[:-1])
LONGEST = " union all ".join(f"select x.doc_id, {n} l from h{n} x join (select h, min(doc_id) d from h{n} group by h) y using (h) where x.doc_id > y.d" for n in LEVELS)

OP1_SQL = f"""
with w as (select doc_id, {WORDS} w from documents),
g as (select doc_id, unnest(range(1, len(w) - 48)) s from w where len(w) >= 50),
h50 as (select g.doc_id, s, md5(array_to_string(w.w[s:s+49], ' ')) h from g join w on g.doc_id = w.doc_id), {DOUBLED},
f as (select h, min(doc_id) d from h50 group by h),
r as (select h50.doc_id, s from h50 join f using (h) where h50.doc_id > f.d),
x as (select distinct doc_id, unnest(range(s, s + 50)) k from r),
a as (select doc_id, list(k) ks from x group by doc_id),
l as (select doc_id, max(l) l from ({LONGEST}) group by doc_id)
select w.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(ks), 0) as bigint) n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(coalesce(ks, []), i) then null else w[i] end), lambda y: y is not null), ' '), '')) kept_sha256,
  cast(coalesce(l.l, 0) as integer) longest
from w left join a using (doc_id) left join l using (doc_id)
"""

OP5_SQL = f"""
with recursive w as (select doc_id, {WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))} w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from w),
x as (select doc_id, hash(unnest(s)) h from s),
c as (select h from x group by h having count(*) > 1),
y as (select x.* from x join c using (h)),
p as (select a.doc_id a, b.doc_id b, count(*) i from y a join y b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * i >= 85 * (len(sa.s) + len(sb.s) - i)),
r as (select doc_id, doc_id o from documents union select r.doc_id, l.b from r join l on l.a = r.o),
m as (select doc_id, min(o) component_id from r group by 1)
select m.doc_id, cast(len(s.s) as bigint) n_shingles, component_id, m.doc_id = component_id kept from m join s using (doc_id)
"""


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode(table(spark, sf_dir, "documents"), n_best=3, ids=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    pages = warc.resolve(warc.read_pages(spark, path, keep_payload=False))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


OP8_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
q as (select page_id, octet_length(b) n, sha1(b) d from p),
r as (select *, case when n >= 1000 then max(page_id) over (partition by d, n >= 1000) else page_id end k from q)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
  case when page_id = k then 'response' else 'revisit' end record_type,
  case when page_id = k then null else k end refers_to
from r
"""

def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(table(spark, sf_dir, "documents"), held("doc_id", 10) != 0)
    return scored.select("doc_id", F.coalesce(held("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_model": op6_quality_model,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_katz": op10_katz,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op5_near_dedup": OP5_SQL, "op8_warc": OP8_SQL}
