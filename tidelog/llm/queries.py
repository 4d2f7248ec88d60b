"""The corpus queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import table
from .decontaminate import REPORT_SQL, contamination_report
from .fingerprint import fingerprint_documents
from .htmltext import extract_pages
from .langid import language_report
from .mixing import mix_report, mix_sql
from .neardup import near_duplicates
from .secretscan import scan_documents
from .sharding import placement
from .toxicity import toxicity_report
from .urlfilter import FILTER_SQL, filter_pages


def queries() -> dict:
    return {
        "op1_fingerprints": lambda s, d: fingerprint_documents(table(s, d, "documents")),
        "op2_html_text": lambda s, d: extract_pages(table(s, d, "pages")),
        "op3_toxicity": lambda s, d: toxicity_report(table(s, d, "documents"), table(s, d, "labels")),
        "op4_secrets": lambda s, d: scan_documents(table(s, d, "documents")),
        "op5_decontamination": lambda s, d: contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_near_duplicates": lambda s, d: near_duplicates(table(s, d, "documents")),
        "op7_sharding": lambda s, d: placement(table(s, d, "documents")),
        "op8_language": lambda s, d: language_report(table(s, d, "documents")),
        "op9_url_filters": lambda s, d: filter_pages(table(s, d, "pages")),
        "op10_mixing": lambda s, d: mix_report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": REPORT_SQL, "op9_url_filters": FILTER_SQL, "op10_mixing": mix_sql()}
