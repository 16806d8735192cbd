"""The contract queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, secrets
from .bpe import encode_decode
from .common import table
from .exact_dedup import exact_duplicates
from .filter_audit import audit
from .hard_negatives import hard_negatives, quantised
from .language import languages
from .near_dedup import near_duplicates
from .packing import pack
from .quality import judged
from .sharding import shards
from .span_dedup import remove_repeats
from .toxicity import toxicity


def op1_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    live = F.size(F.filter("spans", lambda s: s["live"]))
    per = lambda f: F.array_join(F.transform("spans", lambda s: s[f].cast("string")), ",").alias(f)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.described("spans").alias("spans"), live.alias("n_live"), per("repositories"), per("owners"))


def op4_chat(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select * from values (-1L, 0L, 'user'), (-1L, 1L, 'assistant') t(conv_id, turn, role)").withColumn("text", F.lit(own))
    return chat.digests(chat.formatted(turns.unionByName(more)))


def op5_span_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op6_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), keep_ids=False)


def op7_quality(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives(rows, rows.filter(F.col("id") % 50 == 0))


def secret_counts(spark, sf_dir):
    """The base counts of operator 3, which SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark, sf_dir):
    """The base rules of operator 7, which SQL can express."""
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_secrets, op4_chat, op5_span_dedup, op6_bpe, op7_quality, op8_sharding, op9_near_dedup, op10_packing, op11_language_id, op12_filter_audit, op13_hard_negatives, secret_counts, quality_counts)}


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), chr(92), concat(chr(92), chr(92)))"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', concat('{c[0]}', chr(92), '{c[1:]}'))"
    return out


SQL = {
    "op4_chat": f"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
          cast(sum(10 + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars from t group by conv_id
    """,
    "op2_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
    """,
    "op12_filter_audit": """
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        b as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails from d),
        l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
        m as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from b left join l using (doc_id) group by part, fails),
        f as (select unnest(range(1, 6)) as i),
        o as (select [a.i, b.i, c.i, d.i, e.i] as fs from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s as (select array_to_string([substr('ABCDE', x, 1) for x in fs], '') as filter_order, step, fs[step] as f, fs[1 : step - 1] as past from o, (select unnest(range(1, 6)) as step)),
        r as (select part, filter_order, step, f, n, good, toxic, fails[f] as fail, len([x for x in past if fails[x]]) > 0 as gone, len([x for x in fails if x]) as many from m, s),
        t as (select part, filter_order, step, f, sum(case when not fail and not gone then n else 0 end) as kept, sum(case when fail and not gone then n else 0 end) as removed,
          sum(case when fail and gone then n else 0 end) as redundant, sum(case when fail and many = 1 then n else 0 end) as unique_fails,
          sum(case when fail and not gone then good else 0 end) as good_lost, sum(case when fail and not gone then toxic else 0 end) as toxic_lost from r group by all)
        select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
          cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from t
    """,
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
          where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, v.vec_id as other, a.label = v.label as same, cast(list_inner_product(a.q, v.q) as bigint) as score from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0),
        p as (select anchor_id, other, score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
        n as (select p.anchor_id, p.other as positive_id, row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank, s.other as negative_id, p.score as positive_score, s.score as negative_score
          from p join s using (anchor_id) where not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
    """,
    "secret_counts": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, cast(len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda v: length(v) >= 8)) as bigint) as n_assign,
          cast(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) as bigint) as n_access, cast(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 32)) as bigint) as n_hex from d
    """,
    "quality_counts": """
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        l as (select r, unnest(string_split(t, chr(10))) as line from d), k as (select r, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
        s as (select r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
        m as (select r, i from s qualify count(*) over (partition by r, g) > 1), p as (select r, count(distinct i + j) as n_repeat_words from m, (select unnest([0, 1, 2]) as j) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
          coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed from d left join k using (r) left join p using (r)
    """,
}
