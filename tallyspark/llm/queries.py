"""The queries of this subpackage over the driver's tables, with production parameters, and their SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, fim, fingerprints, licenses, lmscore, mixing, packing, pieces, quality, sharding, simhash, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def digest_of_sketches(docs: DataFrame) -> DataFrame:
    made = fingerprints.edited_fingerprints(docs)
    mine = F.col("sketch")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(mine).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(mine, F.col("edited_sketch")).alias("near_edited"), fingerprints.resemblance(mine, F.col("next_sketch")).alias("near_next"),
    )


def op4_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_sketches(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model).drop("text")
    s = F.col("quality_score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(_table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_packing, op3_ann, op4_bottom_k, op5_quality, op6_slots, op7_warc, op8_pseudo_likelihood, op9_mixing, op10_licenses, op11_fill_in_middle, op12_pieces, op13_alignment)
}

#: What archives hold can be told from the pages themselves: the SQL says it without archives.
ORACLES: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
        FROM m""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS varchar), '')) AS x FROM documents),
        h AS (SELECT *, ('0x' || x[1:8])::ubigint AS h1, ('0x' || x[9:16])::ubigint AS h2, ('0x' || x[17:24])::ubigint AS h3, ('0x' || x[25:32])::ubigint AS h4 FROM d),
        c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                     least(h1 % (n + 1), h2 % (n + 1))::bigint AS a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint AS b FROM h),
        p AS (SELECT *, left(t, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
