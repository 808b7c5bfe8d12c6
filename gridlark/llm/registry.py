"""The queries of this subpackage, each applying one operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": q.sentencepiece_query,
    "op2_neighbours": q.neighbours_query,
    "op3_chat_format": q.chat_format_query,
    "op4_media_columns": q.media_query,
    "op5_language_id": q.language_query,
    "op6_token_records": q.token_records_query,
    "op7_pii": q.pii_query,
    "op8_packing": q.packing_query,
    "op9_near_dup": q.near_dup_query,
    "op10_url_filter": q.url_filter_query,
    "op11_prefix_trie": q.prefix_trie_query,
    "op12_turn_repair": q.turn_repair_query,
    "op13_near_vectors": q.near_vectors_query,
    "language_of_pages": q.page_language_query,
}
ORACLES: dict[str, str] = {
    "op3_chat_format": q.CHAT_FORMAT_SQL,
    "op9_near_dup": q.NEAR_DUP_SQL,
    "op10_url_filter": q.URL_FILTER_SQL,
    "op11_prefix_trie": q.PREFIX_TRIE_SQL,
    "op12_turn_repair": q.TURN_REPAIR_SQL,
    "op13_near_vectors": q.NEAR_VECTORS_SQL,
}
