"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, divergence, topk, warc
from .collocations import op12_phrase_collocations
from .decontaminate import op5_benchmark_decontamination
from .divergence import op11_source_divergence
from .language import op4_language_id
from .line_dedup import op2_line_dedup
from .near_dups import op9_minhash_near_dups
from .packing import op8_best_fit_packing
from .pii import op10_pii_pseudonyms
from .quality import op6_quality_classifier
from .secrets import op7_secret_scans
from .token_counts import op1_token_counts
from .topk import op3_exact_topk
from .warc import op13_warc_archives

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_line_dedup, op3_exact_topk, op4_language_id, op5_benchmark_decontamination, op6_quality_classifier,
        op7_secret_scans, op8_best_fit_packing, op9_minhash_near_dups, op10_pii_pseudonyms,
        op11_source_divergence, op12_phrase_collocations, op13_warc_archives,
    )
}
ORACLE = {
    "op3_exact_topk": topk.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_phrase_collocations": collocations.ORACLE_SQL,
    "op13_warc_archives": warc.ORACLE_SQL,
}
