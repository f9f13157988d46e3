"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .hard_negatives import OP11_SQL, op11_voronoi_hard_negatives
from .jaccard_join import op2_jaccard_join
from .language_id import op3_crf_language
from .media import op8_mpeg_ts
from .mixing import op9_mixing
from .packing import op6_bm25_packing
from .sharding import op4_feistel_sharding
from .spelling import OP12_SQL, op12_trie_variants
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op5_toxicity_chain
from .url_filter import OP10_SQL, op10_url_filter
from .vector_search import OP7_SQL, op7_maxscore_topk
from .warc import OP13_SQL, op13_dictionary_warc

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_crf_language, op4_feistel_sharding, op5_toxicity_chain, op6_bm25_packing, op7_maxscore_topk, op8_mpeg_ts, op9_mixing, op10_url_filter, op11_voronoi_hard_negatives, op12_trie_variants, op13_dictionary_warc)}
SQL = {"op7_maxscore_topk": OP7_SQL, "op10_url_filter": OP10_SQL, "op11_voronoi_hard_negatives": OP11_SQL, "op12_trie_variants": OP12_SQL, "op13_dictionary_warc": OP13_SQL}
