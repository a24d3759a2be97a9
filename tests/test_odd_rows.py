"""Queries against their SQL on rows that the small tables lack."""

import os

from docengine.registry import ORACLES, QUERIES
from tests.oracle import TABLES, same


def held(spark, sf, folder, name, texts):
    """The query equals its SQL over these documents: a text, or a text with its lang and source."""
    rows = [(i, *(x if isinstance(x, tuple) else (x, "en", "src0"))) for i, x in enumerate(texts)]
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    documents.selectExpr("*", "length(text) n_chars").write.parquet(f"file://{folder}/documents.parquet")
    same(QUERIES[name](spark, str(folder)), ORACLES[name], str(folder))


def test_titles_keep_line_breaks(spark, sf, tmp_path):
    texts = ["", "Den.\nEt", "", "", "\u00a0a\u3000 b", "", "", "\tab\u2028c", ("", "", "Src "), ("", " ", "src"), ("", None, ""), ("", "\n", "x")]
    held(spark, sf, tmp_path, "f32_titles", texts)


BLANK = [None, "", " \t\r\n", "\f", "\v", "\u00a0", "\u2028 \u3000", "In. The.", "in. the. in. the.", "a tionsh b", "word"]


def test_memo_has_a_vector_for_words_that_cancel(spark, sf, tmp_path):
    held(spark, sf, tmp_path, "i1_embed_memo", BLANK * 2)


def test_batches_have_a_vector_for_words_that_cancel(spark, sf, tmp_path):
    held(spark, sf, tmp_path, "i3_embed_batched", BLANK * 2)


def test_the_better_arm_by_rounded_scores(spark, sf, tmp_path):
    held(spark, sf, tmp_path, "z15_best_of", ["the " + "y" * (i // 12 % 196) for i in range(2400)])


def test_sql_chunks_of_blank_parts(spark, sf, tmp_path):
    texts = [None, "", " ", " " * 900, "\u00a0" + "a" * 900 + "\u2003", "a" * 350 + ". " + " " * 1600 + "b" * 400, "\n" * 900 + "x" * 300, "b" * 798 + ". c", "c" * 797 + ". d", "d" * 300 + ". " + "e" * 900, "\ud55c. " * 500, "f" * 800]
    held(spark, sf, tmp_path, "p1_sql_chunks_all", texts)
