"""One query per operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, embedding_dedup, jaccard_join, language_rank, license_dice, media_ts, packing, pii_crf, quality_knn, spelling, token_store, warc
from .common import held_out_expr, materialise, scratch, table


def op1_pii_crf(spark, sf_dir):
    field = pii_crf.learn(pii_crf.labelled_table(spark))
    return pii_crf.find(table(spark, sf_dir, "documents"), field)


def op2_warc_normalise(spark, sf_dir):
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", F.expr(held_out_expr()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    path = scratch(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path)


def op6_language_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = language_rank.learn(language_rank.training_rows(docs))
    found = language_rank.predict(docs, profiles)
    return found.select("doc_id", F.expr(held_out_expr()).alias("held_out"), "lang_pred", "score")


def op7_vector_pack(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_license_dice(spark, sf_dir):
    return license_dice.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_transport_stream(spark, sf_dir):
    stored = materialise(media_ts.encode(table(spark, sf_dir, "documents")), "media")
    return media_ts.features(stored)


def op11_embedding_int8(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_normalise": warc.ORACLE,
        "op4_ngram_jaccard": jaccard_join.ORACLE,
        "op8_license_dice": license_dice.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op11_embedding_int8": embedding_dedup.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
        "op13_spelling_variants": spelling.ORACLE,
    }
