"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from palimpsest.llm import chat, exact, extract, lines, merkle, near, packing, pieces, pii, quality
from palimpsest.llm.shared import documents


def op1_quality(spark, sf_dir):
    return quality.scores_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_merkle(spark, sf_dir):
    return merkle.edited_query(documents(spark, sf_dir))


def op3_exact(spark, sf_dir):
    return exact.groups_query(documents(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return pii.digest_query(documents(spark, sf_dir))


def op5_lines(spark, sf_dir):
    return lines.lines_query(documents(spark, sf_dir))


def op6_packing(spark, sf_dir):
    return packing.digest_query(documents(spark, sf_dir))


def op7_extract(spark, sf_dir):
    return extract.main_text_query(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_chat(spark, sf_dir):
    return chat.digest_query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_pieces(spark, sf_dir):
    return pieces.digest_query(documents(spark, sf_dir))


def op10_near(spark, sf_dir):
    return near.components_query(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_merkle, op3_exact, op4_pii, op5_lines, op6_packing, op7_extract, op8_chat, op9_pieces, op10_near)}
ORACLE_SQL: dict[str, str] = {"op3_exact": exact.GROUPS_SQL, "op8_chat": chat.DIGEST_SQL, "op10_near": near.COMPONENTS_SQL}
