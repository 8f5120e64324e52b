"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clustering
from .decontaminate import op1_benchmark_decontamination
from .digest_index import OP12_SQL, op12_exact_dedup
from .language import op10_language_id
from .ngram_join import op3_ngram_jaccard_join
from .pii import op6_personal_data
from .quality import op5_quality_classifier
from .resample import OP13_SQL, op13_importance_resampling
from .sentencepiece_codec import op2_sentencepiece
from .token_counts import op4_token_counts
from .topk import OP8_SQL, op8_exact_top_k
from .toxicity import op7_toxicity
from .url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_sentencepiece,
        op3_ngram_jaccard_join,
        op4_token_counts,
        op5_quality_classifier,
        op6_personal_data,
        op7_toxicity,
        op8_exact_top_k,
        op9_url_filter,
        op10_language_id,
        op11_centroid_clustering,
        op12_exact_dedup,
        op13_importance_resampling,
    )
}
SQL = {"op8_exact_top_k": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL}
