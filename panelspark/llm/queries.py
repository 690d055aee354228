"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, chat, decontam, fingerprint, html_text, infill, jaccard, langid, merkle, oracles, packing, pii, quality, substrings
from panelspark.llm.shared import read


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep_text=False)
    return decontam.digest(found)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(probe)))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(read(spark, sf_dir, "documents"), keep_text=False).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels"))).drop("text")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.rewrite(read(spark, sf_dir, "documents")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(read(spark, sf_dir, "documents"), claim=merkle.tampered()))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_substrings": op2_substrings,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_format": op5_chat_format,
    "op6_main_text": op6_main_text,
    "op7_sanitise": op7_sanitise,
    "op8_quality": op8_quality,
    "op9_pack": op9_pack,
    "op10_language": op10_language,
    "op11_infill": op11_infill,
    "op12_manifest": op12_manifest,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op2_substrings": oracles.SUBSTRINGS,
    "op3_decontaminate": oracles.DECONTAMINATE,
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_chat_format": oracles.chat_format(),
    "op11_infill": oracles.INFILL,
    "op12_manifest": oracles.MANIFEST,
}
