"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from siltbed.llm.decontaminate import op3_decontaminate
from siltbed.llm.jaccard_join import op5_jaccard_join
from siltbed.llm.language_id import op10_language_id
from siltbed.llm.license_scan import op6_license_scan
from siltbed.llm.line_dedup import op4_line_dedup
from siltbed.llm.packing import op8_packing
from siltbed.llm.quality import op7_quality
from siltbed.llm.substring_dedup import op1_substring_dedup
from siltbed.llm.suffix_dedup import op2_suffix_dedup
from siltbed.llm.warc import op9_warc


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_decontaminate, op4_line_dedup, op5_jaccard_join, op6_license_scan, op7_quality, op8_packing, op9_warc, op10_language_id)}


def oracle_sql():
    return {}
