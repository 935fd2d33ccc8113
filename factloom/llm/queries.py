"""The registered queries of the training-data operators: thin digests of what the operators return over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontaminate, langid, lines, media, packing, quality, sharding, simhash, token_files, variants


#: Where the tokenizer files of the queries lie.
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
THRESHOLD = 0.7
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): conversations as JSON records of three layouts, and conversation -1 as one of a fourth."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    layouts = [F.struct(role, text, "turn"), F.struct(text.alias("content"), role, F.lit("chat").alias("source")), F.struct(F.struct(role, text.alias("content")).alias("message"))]
    record = F.coalesce(*[F.when(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)) == i, F.to_json(x)) for i, x in enumerate(layouts)])
    said = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return rows.select("conv_id", "turn", record.alias("record")).unionByName(more)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.canonical_turns(op3_records(chat.canonical_rows(table(spark, sf_dir, "conversations"))))
    unread = F.array(F.struct(F.lit("error").alias("role"), F.coalesce("record", F.lit("")).alias("text")))  # nothing is left out
    turns = records.select("conv_id", "turn", F.posexplode(F.coalesce("turns", unread)).alias("pos", "said")).select("conv_id", (F.col("turn") + F.col("pos")).alias("turn"), "said.role", "said.text")
    out = chat.format_turns(turns).withColumn("turns", chat.read_back(F.col("formatted")))
    loss = chat.trained_text(F.col("turns"), F.col("mask"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_table(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("phash")).alias("feature"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score_column(docs, model).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = """
with l as (
  select doc_id, source, i - 1 as pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line, line as raw
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
), b as (
  select line, min(struct_pack(d := doc_id, p := pos)) as f from l where line <> '' group by line having count(distinct source) >= 3
), k as (
  select l.doc_id, l.pos, l.raw, b.line is not null and struct_pack(d := l.doc_id, p := l.pos) <> b.f as gone from l left join b on l.line = b.line
), t as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') as text from k group by doc_id
)
select doc_id, n_lines, n_removed, length(text) as text_chars, sha256(text) as text_sha256 from t
"""


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    p = docs.select("doc_id", held_out().alias("held_out"), langid.language_column(docs, model).alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_inertia(*clusters.kmeans(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10))


def op11_sql(rounds: int = 10) -> str:
    """The same rounds one after the other: distances by component, the smallest number of ties, floor of exact means."""
    steps = [
        """with v as materialized (
  select vec_id, i, floor(1024 * embedding[i]::double)::bigint as x from embeddings, (select unnest(range(1, 65)) as i) where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
), seeds as (
  select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from (select distinct vec_id from v) order by k limit 8
), c0 as materialized (select k::int as k, i, x from seeds join v using (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} as (select vec_id, k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{r} c using (i) group by vec_id, k
), a{r} as materialized (select vec_id, k, d from d{r} qualify row_number() over (partition by vec_id order by d, k) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as (select k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from v join a{r} using (vec_id) group by k, i
), c{r + 1} as materialized (select c.k, c.i, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on c.k = m.k and c.i = m.i)"""
            )
    return (
        ",\n".join(steps)
        + f""", sha as (select k, sha256(string_agg(x::varchar, ',' order by i)) as s from c{rounds} group by k)
select vec_id, a.k as cluster, d as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, s as centroid_sha256 from a{rounds} a join sha on a.k = sha.k
"""
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=1)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), least_letters=7, least_rows=2, noise=31)


# crc32 by its table, built from the polynomial; near words share what is left when each loses a letter
OP13_SQL = """
with recursive t as (
  select n, 0 as bit, n::bigint as c from (select unnest(range(256)) as n)
  union all select n, bit + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where bit < 8
), crc as (select list(c order by n) as t from t where bit = 8
), r as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents
), d as (
  select r, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195, ord(c) - 64] end)) as b from r
), h as (
  select r, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) as h from d, crc
), w as materialized (
  select word, count(*) as n from (select case when h % 31 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word from h) where length(word) >= 7 group by word having count(*) >= 2
), cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)
), pairs as materialized (
  select a.word, a.n, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, a.n, w.word, w.n from cut a join w on a.rest = w.word
  union select w.word, w.n, a.word, a.n from cut a join w on a.rest = w.word
), near as materialized (
  select word, n, count(*) as n_near, first(other order by m desc, other) as best, max(m) as m from pairs group by word, n
), form as materialized (select word, best as form, m from near where m >= 10 * n
), walk as (
  select word, form as last_form, 1 as step from form union all select walk.word, form.form, step + 1 from walk join form on walk.last_form = form.word
), roots as (select word, last(last_form order by step) as root from walk group by word)
select w.word, form.form, coalesce(roots.root, w.word) as root, w.n, coalesce(near.n_near, 0) as n_near, form.m as form_n
from w left join near on w.word = near.word left join form on w.word = form.word left join roots on w.word = roots.word
"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_chat, op4_simhash, op5_media, op6_token_files, op7_quality, op8_line_dedup, op9_langid, op10_sharding, op11_clusters, op12_packing, op13_variants)}
ORACLE_SQL = {"op8_line_dedup": OP8_SQL, "op11_clusters": op11_sql(), "op13_variants": OP13_SQL}
