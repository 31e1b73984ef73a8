"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, fill_middle, jaccard_join, line_dedup, media, mixing, packing, pii, token_codec, topk, toxicity, url_filter, vector_codes
from .common import materialize, table

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's log10 probability by the class model and by word counts alone, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return brown_lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text before dropping, lines dropped, and the hash of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), l as (
  select r, doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select r, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from d)
), k as (
  select key, max(doc_id) as keeper from l where length(key) >= 40 group by key having count(distinct r) >= 5
), m as (
  select l.r, l.doc_id, l.n, l.line, k.keeper is not null and k.keeper <> l.doc_id as dropped from l left join k using (key)
)
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (not dropped), '')) as kept_sha256
from m group by r, doc_id
"""


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, max_epochs=2).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), text, '')) as k from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as n from d group by source
), w as (
  select *, [5, 2, 1][(n - 1) % 3 + 1] as weight from s
), c as (
  select *, 1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over o, 0) as open_words, sum(weight) over () - coalesce(sum(weight) over o, 0) as open_weight
  from w window o as (order by source_size / weight, n rows between unbounded preceding and 1 preceding)
), f as (
  select open_words / open_weight as level from c where open_words * weight <= 2 * source_size * open_weight order by source_size / weight, n limit 1
), t as (
  select source, source_size, coalesce(least(cast(2 * source_size as double), (select level from f) * weight), cast(2 * source_size as double)) as target from w
), p as (
  select *, least(2, coalesce(cast(floor(target / nullif(source_size, 0)) as bigint), 0)) as repeats from t
), x as (
  select d.*, p.source_size, p.target, p.repeats, floor(p.target) - p.repeats * p.source_size
    - coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as open_words
  from d join p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target, cast(repeats * size + greatest(0, least(size, open_words)) as bigint) as taken from x
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each text by the grammar learned from the labelled rows that aren't held out. A null id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_texts(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a media container in a table of the shared folder, then read back from there: payload, probe, digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.pack_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = materialize(stored).withColumns({"probe": media.probe_media(F.col("media")), "payload": media.read_payload(F.col("media"))})
    ranges = F.transform("probe.keyframes", lambda k: F.concat_ws("-", k["start"], k["end"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "probe.codec", F.try_divide("probe.duration", "probe.timescale"), F.concat_ws(",", ranges)).alias("feature"),
        F.col("probe.codec").alias("codec"),
        F.try_divide("probe.duration", "probe.timescale").alias("seconds"),
        F.size("probe.keyframes").cast("long").alias("n_keyframes"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of each document."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each page's URL, by explicit rules and else by mined ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of each query row by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, F.col("vec_id") % 50 == 0, k=5)


OP8_SQL = """
with v as (
  select row_number() over () as r, vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.r as query, q.vec_id as query_id, c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies; a bin holds one document of a group of near copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": packing.length_of("text"), "own": packing.hash_of("text")}
    marked = packing.near_clusters(docs, threshold=0.8, keep=slim)
    return packing.pack_documents(marked, capacity=2048, per_source=2, cluster="cluster", size=F.col("size"), own=F.col("own"))


def op10_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the coded files."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_codec.encode_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each vector by codebooks of 64 entries for 16 parts, and its error."""
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2).drop("label")


def _op11_sql(rounds: int = 2) -> str:
    """Entries are rows (part, entry, e); every round assigns all parts and replaces the entries in use."""
    assigned = """
a{n} as (
  select part, r, arg_min(entry, d * 64 + entry) as entry, min(d) as d, any_value(p) as p from (
    select v.part, v.r, c.entry, v.p, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.p, c.e)])::bigint as d from parts v join c{n} c using (part)
  ) group by part, r
)"""
    update = """
c{m} as (
  select c.part, c.entry, coalesce(u.e, c.e) as e from c{n} c left join (
    select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from (
      select part, entry, i, sum(p[i]) as s, count(*) as n from a{n}, range(1, 5) t(i) group by part, entry, i
    ) group by part, entry
  ) u using (part, entry)
)"""
    steps = ",".join(assigned.format(n=n) + (("," + update.format(n=n, m=n + 1)) if n < rounds else "") for n in range(rounds + 1))
    return f"""
with v as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), parts as (
  select r, part, e[4 * part + 1 : 4 * part + 4] as p from v, range(16) t(part)
), c0 as (select part, cast(r - 1 as bigint) as entry, p as e from parts where r <= 64), {steps}, f as (
  select r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by r
), t as (
  select label, cast(sum(error) as bigint) as label_error from v join f using (r) group by label
)
select v.vec_id, f.code, f.error, t.label_error,
  (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) from c{rounds}) as codebooks_sha256
from v join f using (r) join t on v.label is not distinct from t.label
"""


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans of each text, and all spans with those that the field adds."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit(pii.example_table(spark)))
    base = F.filter("spans", lambda s: s["method"] == "base")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text cut at two seeded lines, and of the text made of that again."""
    cut = fill_middle.fill_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents
), h as (
  select *, len(u) - cast(u[-1] = '' as bigint) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from h
), e as (
  select *, case when a = 0 then 0 when a = len(u) then length(text) else length(array_to_string(u[1:a], chr(10))) + 1 end as i,
    case when b = 0 then 0 when b = len(u) then length(text) else length(array_to_string(u[1:b], chr(10))) + 1 end as j
  from c
), p as (
  select *, substring(text, 1, i) as prefix, substring(text, i + 1, j - i) as middle, substring(text, j + 1) as suffix from e
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(i as bigint) end as prefix_chars, case when form <> 'plain' then cast(j - i as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p
"""


QUERIES = {"op1_brown_lm": op1_brown_lm, "op2_line_dedup": op2_line_dedup, "op3_source_mix": op3_source_mix, "op4_toxicity": op4_toxicity, "op6_jaccard_join": op6_jaccard_join, "op9_best_fit_packing": op9_best_fit_packing, "op10_token_codec": op10_token_codec, "op5_media_columns": op5_media_columns, "op7_url_filter": op7_url_filter, "op8_exact_topk": op8_exact_topk, "op11_vector_codes": op11_vector_codes, "op12_pii_spans": op12_pii_spans, "op13_fill_middle": op13_fill_middle}
ORACLES = {"op2_line_dedup": OP2_SQL, "op3_source_mix": OP3_SQL, "op8_exact_topk": OP8_SQL, "op11_vector_codes": _op11_sql(), "op13_fill_middle": OP13_SQL}
