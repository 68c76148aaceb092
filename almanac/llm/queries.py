"""The registered queries of this subpackage and their DuckDB checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, chains, chat, compression, decontaminate, fingerprints, interaction, licences, pii, quality, search, setjoin, suffixes
from almanac.llm import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Fixed value: the conversation whose texts hold a template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


@query(
    "op1_chat_prefix_targets",
    rf"""
    with said as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
    ), written as (
        select *, length('<turn >') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
            + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 8 as chars,
            sum(chars) over w as upto,
            row_number() over w = count(*) over (partition by conv_id) as last
        from said window w as (partition by conv_id order by turn, role, text rows unbounded preceding)
    )
    select conv_id, count(*)::bigint as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(upto) filter (role = 'assistant' or last)::bigint as formatted_chars,
        count(*) filter (role = 'assistant')::bigint as n_targets
    from written group by conv_id""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted by prefix-target expansion, read back from the examples."""
    real = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    examples = chat.prefix_targets(real.unionByName(probe))
    read = examples.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("loss").alias("n_targets"),
    )
    turns = chat.read_turns(F.col("formatted"))
    back = whole.select("*", turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_targets",
    )


@query("op2_private_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_private(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listed(pii.base_only(F.col("spans"))).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


@query("op3_substring_chains")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that a document shares, exactly or nearly, with another one."""
    return chains.find_passages(table(spark, folder, "documents"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with the word vocabulary and decoded again, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path)
    kind = coded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = T.arrow_schema(schema)

    def digest(batches):
        for batch in batches:
            ids, decoded = batch.column(1), batch.column(2)
            flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([hashlib.sha256(flat[a:z].tobytes()).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
                ],
                schema=out,
            )

    return coded.mapInArrow(digest, schema)


@query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the byte strings that also start earlier."""
    kept = suffixes.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_bm25_top_k")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose id 100 divides, against all documents."""
    docs = table(spark, folder, "documents")
    asked = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, asked)


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, folder, "documents")
    # Odd keys are held out.
    marks = quality.learn_marks(docs, table(spark, folder, "labels").where(F.col("doc_id") % 2 == 0))
    return quality.score_documents(docs, quality.fit(docs, marks=marks))


@query(
    "op9_ngram_jaccard_join",
    r"""
    with recursive split as (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents
    ), shingles as (
        select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle
        from split
    ), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    common as (
        select a.doc_id as a, b.doc_id as b, count(*) as n_common
        from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
    ), links as (
        select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * n_common >= 80 * (x.n + y.n - n_common)
    ), reached as (
        select doc_id as a, doc_id as b from documents
        union select r.a, l.b from reached r join links l on r.b = l.a
    )
    select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, (select min(b) from reached where a = d.doc_id) as component_id
    from documents d left join sizes s using (doc_id)""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The class of linked documents that each document is in."""
    return setjoin.link_classes(table(spark, folder, "documents"))


@query("op10_licence_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and tags in every document."""
    found = licences.scan_licences(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels", "expressions")})


def _rounds_in_sql() -> str:
    """The plain rounds, one table after the other; parts of the tables' vectors have eight components."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    mean = ", ".join(f"floor(sum(x[{i}]) / count(*))::bigint" for i in range(1, 9))
    steps = ""
    for i in range(compression.ROUNDS + 1):
        steps += f"""
        a{i} as materialized (
            select vec_id, p, any_value(label) as label, any_value(x) as x, min({apart} * 16 + e) as best from parts join b{i} using (p) group by vec_id, p
        ),"""
        if i < compression.ROUNDS:
            steps += f"""
        m{i} as (select p, best % 16 as e, [{mean}] as mean from a{i} group by 1, 2),
        b{i + 1} as materialized (select p, e, coalesce(mean, c) as c from b{i} left join m{i} using (p, e)),"""
    last = f"{compression.ROUNDS}"
    return f"""
    with kept as (
        select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), parts as materialized (select vec_id, label, p, v[p * 8 + 1:p * 8 + 8] as x from kept, range(8) t(p)),
    b0 as materialized (
        select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts
        where vec_id in (select vec_id from kept order by vec_id limit 16)
    ),{steps}
    coded as (
        select vec_id, any_value(label) as label, string_agg(printf('%02x', (best % 16)::int), '' order by p) as code, sum(best // 16)::bigint as error
        from a{last} group by vec_id
    ), books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{last})
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books"""


@query("op11_vector_codes", _rounds_in_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's product code, with the errors of its label and the codebooks' digest."""
    fitted = compression.fit(table(spark, folder, "embeddings"))
    books = ",".join(str(x) for part in fitted.books.entries for x in part.ravel().tolist())
    coded = compression.label_errors(compression.encode(fitted))
    return coded.select(
        F.col("key").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(books.encode()).hexdigest()).alias("codebooks_sha256"),
    )


@query(
    "op12_filter_audit",
    r"""
    with said as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as first from said),
    marked as (
        select doc_id, part,
            (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
            + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id > first)::int as mask
        from split
    ), known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    counts as (
        select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
        from marked left join known using (doc_id) group by all
    ), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as b),
    orders as (
        select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
        from letters a, letters b, letters c, letters d, letters e where a.b + b.b + c.b + d.b + e.b = 31
            and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
    ), steps as (
        select filter_order, s::int as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as before
        from orders, range(1, 6) r(s)
    )
    select part, filter_order, step,
        coalesce(sum(n) filter (mask & (before + bit) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost,
        coalesce(sum(n * (120 // greatest(bit_count(mask::int), 1))) filter (mask & bit > 0), 0)::bigint as shapley
    from counts, steps group by part, filter_order, step""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from the documents of each language, in every order."""
    return interaction.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_document_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next one."""
    both = fingerprints.edited_documents(table(spark, folder, "documents"))
    own = F.col("fingerprint")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )
