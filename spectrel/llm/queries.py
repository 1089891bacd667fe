"""The registered queries of the corpus operators, each over its whole table; and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, fullpacking, html, langid, lexical, packing, quality, repair, secrets, simhash, suffixes, whitening
from .common import held_out, read_table


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents"), byte_tokenizer())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"), secrets.train(spark))
    return found.select("doc_id", "start", "length", "kind", F.sha2("found", 256).alias("found_sha256"), "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), byte_tokenizer())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fullpacking.pack_whole(read_table(spark, sf_dir, "documents"), word_tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repair": op1_repair,
        "op2_language_id": op2_language_id,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_html": op4_html,
        "op5_simhash": op5_simhash,
        "op6_decontamination": op6_decontamination,
        "op7_secrets": op7_secrets,
        "op8_ann": op8_ann,
        "op9_packing": op9_packing,
        "op10_quality": op10_quality,
        "op11_lexical": op11_lexical,
        "op12_whitening": op12_whitening,
        "op13_best_fit": op13_best_fit,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""with b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
 bw as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0),
 bg as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from bw),
 d as (select doc_id, {_WORDS} as w from documents),
 dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, (select distinct n from bg) where len(w) >= n),
 hits as (select doc_id, i, bg.n, item_id from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from dw) x join bg on bg.n = x.n and bg.g = x.g),
 places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
 items as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hits group by doc_id)
 select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join places using (doc_id) left join items using (doc_id)"""


#: The exact nearest, for tables on which all products can be taken.
OP8_SQL = """with v as (select row_number() over () as i, vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 s as (select a.i, a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e) as score from v a join v b on a.vec_id % 20 = 0 and a.i <> b.i and len(a.e) = len(b.e)),
 r as (select *, row_number() over (partition by i order by score desc, vec_id) as n from s)
 select query_id, n::int as rank, vec_id, score from r where n <= 20"""


_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP11_SQL = f"""with d as (select row_number() over () as r, doc_id, text from documents),
 t as (select r, doc_id, {_TERMS} as term from d),
 p as (select r, doc_id, term, count(*)::bigint as tf from t group by r, doc_id, term),
 l as (select r, sum(tf)::bigint as n from p group by r),
 c as (select count(*)::bigint as docs, sum(n)::bigint as terms from l),
 f as (select term, count(*)::bigint as df from p group by term),
 i as (select distinct item_id, {_TERMS} as term from benchmark),
 w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from f, c),
 m as (select r, (10 + (90 * n * docs) // terms)::bigint as m from l, c),
 s as (select item_id, p.r, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from i join w using (term) join p using (term) join m on m.r = p.r group by item_id, p.r, p.doc_id),
 o as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as n from s where score > 0)
 select item_id, n::int as rank, doc_id, score from o where n <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op8_ann": OP8_SQL, "op11_lexical": OP11_SQL}
