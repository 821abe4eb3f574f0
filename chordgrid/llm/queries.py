"""One query for each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chordgrid.llm import exact_dedup, fill_middle, licences, media, mixing, ngram_join, packing, piece_codec, repeated_spans, sharding, token_counts, toxicity, vector_codes
from chordgrid.llm.common import WORD, documents, text_of
from chordgrid.llm.tokenizing import tokenizer_path
from chordgrid.operators.storage import shared_dir


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_texts(documents(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), F.octet_length(text_of("text")) + 1)
    written = sharding.write_shards(sharded, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return written.select(
        "row.doc_id", "size", F.crc32(text_of("row.text").cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), size=F.regexp_count(text_of("text"), F.lit(WORD)), carry=["doc_id"])
    return mixing.taken_words(*mixed).select("row.doc_id", "size", "source_size", "target", "taken", "first_slot")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = piece_codec.round_trip(documents(spark, sf_dir), piece_codec.model_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256 if books is not None else None).cast("string"))


def _codes_sql(rounds: int = 6) -> str:
    """Six rounds of assignments and floored means over eight parts of eight components, then the last assignment."""
    places = range(1, 9)
    cut = ", ".join(f"CAST(floor(4096 * CAST(embedding[p * 8 + {i}] AS DOUBLE)) AS BIGINT) AS x{i}" for i in places)
    squares = " + ".join(f"(x.x{i} - c.x{i}) * (x.x{i} - c.x{i})" for i in places)
    means = ", ".join(f"coalesce((s{i} - ((s{i} % n) + n) % n) // n, c.x{i})::BIGINT AS x{i}" for i in places)
    sums = ", ".join(f"sum(x{i}) AS s{i}" for i in places)
    columns = ", ".join(f"x{i}" for i in places)
    steps = [f"""
        pt AS MATERIALIZED (SELECT vec_id, label, p, {cut} FROM embeddings, range(8) t(p)
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        c0 AS MATERIALIZED (SELECT p, k, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM pt) WHERE k < 16)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, {", ".join(f"x.x{i}" for i in places)}, min(({squares}) * 16 + c.k) AS best
            FROM pt x JOIN c{r} c ON c.p = x.p GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT p, best % 16 AS k, count(*) AS n, {sums} FROM a{r} GROUP BY 1, 2),
                c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, {means} FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)""")
    return f"""WITH {", ".join(steps)},
        er AS (SELECT vec_id, label, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2),
        bk AS (SELECT sha256(string_agg(concat_ws(',', {columns}), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM er, bk"""


QUERIES = {
    "op1_media": op1_media,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_repeated_spans": op6_repeated_spans,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_licences": op10_licences,
    "op11_fill_middle": op11_fill_middle,
    "op12_piece_codec": op12_piece_codec,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_fill_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
            h AS (SELECT *, len(u) AS n, ('0x' || k[1:8])::BIGINT AS h1, ('0x' || k[9:16])::BIGINT AS h2, ('0x' || k[17:24])::BIGINT AS h3, ('0x' || k[25:32])::BIGINT AS h4 FROM u),
            f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
            c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM c""",
    "op13_vector_codes": _codes_sql(),
}
