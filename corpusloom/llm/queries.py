"""The subpackage's named queries and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op4_bpe
from .divergence import op13_source_divergence
from .fingerprint import op10_lz_fingerprint
from .html import op5_html_extraction
from .language import op8_language_id
from .licenses import op9_license_scans
from .mixing import op3_mixing
from .neardup import op6_minhash_neardup
from .passages import op12_passage_quality
from .quality import op1_quality_rules
from .sharding import op7_sharding
from .sql import LICENSES, NEAR_DUPLICATES, SOURCE_DIVERGENCE
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_mixing, op4_bpe, op5_html_extraction, op6_minhash_neardup, op7_sharding, op8_language_id, op9_license_scans, op10_lz_fingerprint, op11_alignment, op12_passage_quality, op13_source_divergence)}
ORACLES = {"op6_minhash_neardup": NEAR_DUPLICATES, "op9_license_scans": LICENSES, "op13_source_divergence": SOURCE_DIVERGENCE}
