"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chosen_path import OP7_SQL, op7_chosen_path
from .importance_resampling import op12_importance_resampling
from .patience_licenses import op10_patience_licenses
from .preference_pairs import OP9_SQL, op9_preference_pairs
from .recurrent_lm import op4_recurrent_lm
from .subword_quality import op6_subword_quality
from .subvector_centroids import OP11_SQL, op11_subvector_centroids
from .suffix_repeats import op2_suffix_repeats
from .temperature_mixing import op3_temperature_mixing
from .token_files import op1_token_files
from .warc_archive import OP13_SQL, op13_warc_archive
from .weighted_sampling import op5_weighted_sampling
from .winnow import OP8_SQL, op8_winnow

QUERIES = {f.__name__: f for f in (op1_token_files, op2_suffix_repeats, op3_temperature_mixing, op4_recurrent_lm, op5_weighted_sampling, op6_subword_quality, op7_chosen_path, op8_winnow, op9_preference_pairs, op10_patience_licenses, op11_subvector_centroids, op12_importance_resampling, op13_warc_archive)}
ORACLE_SQL = {"op7_chosen_path": OP7_SQL, "op8_winnow": OP8_SQL, "op9_preference_pairs": OP9_SQL, "op11_subvector_centroids": OP11_SQL, "op13_warc_archive": OP13_SQL}
