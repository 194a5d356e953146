"""The registered queries of this subpackage with their SQL."""

from __future__ import annotations

from noticemill.llm import (collocations, decontamination, html_extraction, language_id, line_dedup, packing, preference_format,
                            quality_rules, secret_scan, simhash, token_alignment, token_files, url_filters)

_MODULES = (line_dedup, preference_format, decontamination, packing, quality_rules, secret_scan, language_id, url_filters, simhash,
            html_extraction, collocations, token_alignment, token_files)


def entries() -> dict:
    return {name: entry for module in _MODULES for name, entry in module.ENTRIES.items()}
