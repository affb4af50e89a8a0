"""Queries of the corpus operators under the driver's contract, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from variorum.llm import ann, byte_bpe, collocations, decontaminate, license_scan, lm_scoring, near_dedup, packing, substring_dedup, toxicity, url_filter, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), threshold=Fraction(85, 100))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.mark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(_read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_ann": op5_ann,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Queries without SQL (4 to 9, 11, 12) learn, search approximately, merge ranks, add labels of their own or decompose.
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": f"""
with recursive w as (select doc_id, {_SPACED.format(_LOWER)} w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
one as (select doc_id, unnest(s) x from s),
shared as (select a.doc_id a, b.doc_id b, count(*) n from one a join one b using (x) where a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join s p on p.doc_id = a join s q on q.doc_id = b where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
ends as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from s union select r.a, e.b from reach r join ends e on e.a = r.b),
least as (select a doc_id, min(b) component_id from reach group by 1)
select doc_id, cast(len(s) as bigint) n_shingles, component_id, doc_id = component_id kept from s join least using (doc_id)""",
    "op2_substring_dedup": f"""
with w as (select doc_id, {_SPACED.format("coalesce(text, '')")} w from documents),
spot as (select doc_id, w, unnest(range(1, len(w) - 33)) i from w where len(w) >= 35),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') x from spot),
twice as (select x from win group by x having count(*) > 1),
gone as (select distinct doc_id, i + k i from win join twice using (x), range(35) r(k)),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from w),
kept as (select doc_id, string_agg(x, ' ' order by i) t from word anti join gone using (doc_id, i) group by 1),
n as (select doc_id, count(*) n from gone group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id) left join n using (doc_id)""",
    "op3_warc": """
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= 100 group by 1)
select page_id, n payload_bytes, p.d payload_digest, case when first <> page_id then 'revisit' else 'response' end record_type, case when first <> page_id then first end refers_to from p left join f on p.d = f.d and n >= 100""",
    "op10_decontaminate": f"""
with i as (select item_id, {_ALNUM} w from benchmark),
iw as (select distinct item_id, least(10, len(w)) n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda j: array_to_string(w[j:j + 9], ' '))) x from i where len(w) > 0),
d as (select doc_id, {_ALNUM} w from documents),
size as (select distinct n from iw),
spot as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) j from d, size where len(w) >= n),
hit as (select doc_id, j, n, array_to_string(w[j:j + n - 1], ' ') x from spot where array_to_string(w[j:j + n - 1], ' ') in (select x from iw)),
pos as (select doc_id, count(distinct j + k) n_hit from hit, range(10) r(k) where k < n group by 1),
names as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) t from (select distinct doc_id, cast(item_id as varchar) item from hit join iw using (n, x)) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join pos using (doc_id) left join names using (doc_id)""",
    "op13_collocations": rf"""
with piece as (select coalesce(lang, 'und') lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')) p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from piece),
spot as (select lang, w, size, unnest(range(1, len(w) - size + 2)) i from w, range(1, 5) s(size) where len(w) >= size),
f as (select lang, size, array_to_string(w[i:i + size - 1], ' ') phrase, count(*) a from spot group by all),
n as (select lang, sum(len(w)) n from w group by 1),
cand as (select lang, size, phrase, string_split(phrase, ' ') w, a from f where size > 1 and a >= 30),
inside as (select lang, w, size, a, unnest(range(2, size)) z from cand where size > 2),
sub as (select lang, a, z, w, unnest(range(1, size - z + 2)) i from inside),
longer as (select lang, array_to_string(w[i:i + z - 1], ' ') phrase, max(a) most from sub group by all),
kept as (select c.* from cand c left join longer o using (lang, phrase) where most is null or 100 * cast(most as hugeint) < 80 * cast(a as hugeint)),
cut as (select *, unnest(range(1, size)) k from kept),
score as (select c.lang, c.phrase, c.a, c.k, x.a l, y.a r, (2000000 * cast(c.a as hugeint)) // (cast(x.a as hugeint) + y.a) score from cut c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from score qualify row_number() over (partition by lang, phrase order by score, k) = 1),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from best)
select lang, rank, phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score from placed join n using (lang) where rank <= 2000""",
}
