"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import hard_negatives, license_scan, mixing, ngram_join, secret_scan, url_filter
from .embed_dedup import op9_embed_dedup
from .hard_negatives import op13_hard_negatives
from .license_scan import op6_license_scan
from .mil_quality import op10_quality_classifier
from .mixing import op3_mixing
from .ngram_join import op7_ngram_join
from .packing import op8_packing
from .periodic_runs import op11_periodic_runs
from .pii import op2_pii
from .quality_llr import op1_quality_rules
from .secret_scan import op12_secret_scan
from .toxicity import op4_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.oracle(),
        "op5_url_filter": url_filter.oracle(),
        "op6_license_scan": license_scan.oracle(),
        "op7_ngram_join": ngram_join.oracle(),
        "op12_secret_scan": secret_scan.oracle(),
        "op13_hard_negatives": hard_negatives.oracle(),
    }
