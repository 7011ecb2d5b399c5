"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silthouse.llm import lines, spellings, trie, urls, warc
from silthouse.llm.decontaminate import op9_decontaminate
from silthouse.llm.lines import op3_line_dedup
from silthouse.llm.matroska import op1_matroska
from silthouse.llm.packing import op4_best_fit_packing
from silthouse.llm.pii import op5_pii
from silthouse.llm.quality import op6_quality
from silthouse.llm.simhash import op10_simhash
from silthouse.llm.spellings import op12_spelling_variants
from silthouse.llm.substrings import op2_substrings
from silthouse.llm.syncmers import op11_syncmers
from silthouse.llm.trie import op13_prefix_trie
from silthouse.llm.urls import op7_url_filter
from silthouse.llm.warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_substrings": op2_substrings,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_syncmers": op11_syncmers,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.SQL,
    "op7_url_filter": urls.SQL,
    "op8_warc": warc.SQL,
    "op12_spelling_variants": spellings.SQL,
    "op13_prefix_trie": trie.SQL,
}
