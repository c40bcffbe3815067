"""The queries of this subpackage, by the names they are registered under, and their SQL for DuckDB."""

from __future__ import annotations

from . import jaccard, katz, knn, langid, media, mixing, pieces, pii, quality, warc

QUERIES = {
    "op1_media_columns": media.op1,
    "op2_top_k": knn.op2,
    "op3_katz": katz.op3,
    "op4_jaccard": jaccard.op4,
    "op5_warc": warc.op5,
    "op6_quality_classifier": quality.op6,
    "op7_mixing": mixing.op7,
    "op8_pii": pii.op8,
    "op9_sentencepiece": pieces.op9,
    "op10_language_id": langid.op10,
}
#: The others have no SQL: they write and read files, learn a model or draw from one; tests hold them against brute force.
SQL = {"op2_top_k": knn.SQL, "op5_warc": warc.SQL, "op7_mixing": mixing.SQL}
