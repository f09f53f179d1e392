"""Queries of this package and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import chat_format, collocations, decontamination, exact_dedup, html_text, prefix_trie, quality, secrets, toxicity, warc
from loomlog.llm.bpe import op5_bpe
from loomlog.llm.simhash import op9_simhash
from loomlog.llm.token_file import op1_token_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_warc": warc.op2_warc,
    "op3_secrets": secrets.op3_secrets,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_html_text": html_text.op6_html_text,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_collocations": collocations.op12_collocations,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op11_chat_format": chat_format.SQL,
    "op12_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
    "op2_warc": warc.SQL,
    "op3_secrets": secrets.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
}
