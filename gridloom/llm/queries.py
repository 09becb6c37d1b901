"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, bpe, host_rules, language, mixing, pii, quality, toxicity
from .common import Scratch, remainder, table
from .line_dedup import without_recurring
from .ngram_join import link_documents
from .packing import pack, vocabulary
from .vectors import link_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return link_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), size=3, percent=90)


@query
def op4_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), vocabulary(), capacity=4096, end_id=1)


@query
def op9_embedding_near_dedup(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op9"), cosine=0.93)


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs, folds=5))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def labelled_scores(spark, sf_dir, module, label, threshold, **more):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = module.predict(docs, module.fit(docs, labels, label, folds=3, held=1), **more)
    more = [c for c in out.columns if c not in ("doc_id", "score")]
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


@query
def op5_quality_classifier(spark, sf_dir):
    return labelled_scores(spark, sf_dir, quality, "quality", 0.5)


@query
def op6_toxicity(spark, sf_dir):
    return labelled_scores(spark, sf_dir, toxicity, "toxic", 0.7, with_spans=True)


@query
def op10_line_dedup(spark, sf_dir):
    return without_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op10"))


@query
def op3_host_quality_rules(spark, sf_dir):
    out = host_rules.verdicts(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


@query
def op2_mixing_sources(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"), "source", "copies")


@query
def op8_pii_surrogates(spark, sf_dir):
    # a fixed key, so that reruns agree; production passes its own secret
    return pii.surrogates(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), key=b"surrogate-key-of-the-registered-query")


@query
def op11_tokenizer_alignment(spark, sf_dir):
    files, scratch = alignment.Tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model")), Scratch(spark, "op11")
    found = alignment.aligned(table(spark, sf_dir, "documents"), files, derive={"groups_sha256": alignment.group_digests})
    # rows are numbered as they are written, so that the numbers stay
    rows = scratch.keep(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("link_a").cast("long").alias("n_links"), "groups_sha256", "link_a", "link_b"))
    return alignment.scored(rows, scratch.keep(alignment.pair_counts(rows)), files).drop("row")


@query
def op12_bpe_round_trip(spark, sf_dir):
    path = vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return bpe.decode(encoded, path, keep=("doc_id", "ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op13_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_REACH = """reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as least from reach group by a)"""

ORACLES["op1_ngram_jaccard_join"] = f"""with recursive words as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
every as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as s from words),
sets as (select distinct doc_id, s from every), sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)), {_REACH}
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id from documents left join sizes using (doc_id) left join least on a = doc_id"""

ORACLES["op9_embedding_near_dedup"] = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.93), degree as (select a as id, count(*) as n from links group by a), {_REACH}
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id <= coalesce(least, vec_id) as kept from embeddings left join degree on id = vec_id left join least on a = vec_id"""

ORACLES["op3_host_quality_rules"] = f"""with texts as (select doc_id, source, coalesce(text, '') as t from documents),
words as (select doc_id, source, t, {_WORDS.format(text="t")} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from texts),
spots as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8), windows as (select doc_id, i, array_to_string(w[i:i+7], ' ') as k from spots),
twice as (select doc_id, unnest(range(i, i + 8)) as p from (select *, count(*) over (partition by doc_id, k) as c from windows) where c > 1), covered as (select doc_id, count(distinct p) as n from twice group by doc_id),
base as (select doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from words left join covered using (doc_id)),
failing as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base),
hosts as (select source, count(*) as n, count(*) filter (base_failed) as f from failing group by source), moments as (select sum(f) / sum(n) as m, var_pop(f / n) as v, avg(1 / n) as inv from hosts),
prior as (select m, case when m > 0 and m < 1 then greatest(1.0, m * (1 - m) / greatest(v - m * (1 - m) * inv, m * (1 - m) * 1e-3) - 1) else 1.0 end as k from moments),
rates as (select source, m > 0 and m < 1 and (f + k * m) / (n + k) >= m + 2 * sqrt(m * (1 - m) / (k + 1)) as host_failed from hosts, prior)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, host_failed,
not base_failed and not (host_failed and (10 * n_symbols > n_words or 5 * n_dup_lines > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words)) as kept
from failing join rates on failing.source is not distinct from rates.source"""

ORACLES["op13_filter_audit"] = f"""with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents), words as (select *, {_WORDS.format(text="t")} as w, min(doc_id) over (partition by t) as first from texts),
marks as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as m from words),
good as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id), docs as (select part, m, coalesce(good, false) as good, coalesce(toxic, false) as toxic from marks left join good using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit), orders as (select [p.bit, q.bit, r.bit, s.bit, u.bit] as bits, p.x || q.x || r.x || s.x || u.x as filter_order from letters p, letters q, letters r, letters s, letters u where p.bit + q.bit + r.bit + s.bit + u.bit = 31 and len(list_distinct([p.bit, q.bit, r.bit, s.bit, u.bit])) = 5),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step, bits from orders), placed as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from steps),
counted as (select part, filter_order, step::int as step, bit, count(*) filter (m & before = 0 and m & bit = 0) as kept, count(*) filter (m & before = 0 and m & bit <> 0) as removed, count(*) filter (m & before <> 0 and m & bit <> 0) as redundant, count(*) filter (m = bit) as unique_fails,
count(*) filter (m & before = 0 and m & bit <> 0 and good) as good_lost, count(*) filter (m & before = 0 and m & bit <> 0 and toxic) as toxic_lost from docs, placed group by all)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from counted"""
