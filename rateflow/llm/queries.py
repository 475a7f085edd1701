"""Registered queries of this folder: one per operator, over whole tables."""

from __future__ import annotations

from rateflow.llm.brown import op10_brown_classes
from rateflow.llm.centroids import ORACLE as CENTROID_SQL
from rateflow.llm.centroids import op13_heap_kmeans
from rateflow.llm.dac import op4_direct_codes
from rateflow.llm.html_boost import op8_boosted_dom
from rateflow.llm.langcnn import op6_byte_cnn
from rateflow.llm.packing import op9_cutting_stock
from rateflow.llm.pii import op3_feistel_pii
from rateflow.llm.pu_quality import op2_pu_quality
from rateflow.llm.simhash import op7_simhash_bk
from rateflow.llm.spotsigs import op1_spotsigs
from rateflow.llm.templates import op5_template_leaks
from rateflow.llm.trie import ORACLE as TRIE_SQL
from rateflow.llm.trie import op11_prefix_trie
from rateflow.llm.warc import ORACLE as WARC_SQL
from rateflow.llm.warc import op12_warc_segments

QUERIES = {
    "op1_spotsigs": op1_spotsigs,
    "op2_pu_quality": op2_pu_quality,
    "op3_feistel_pii": op3_feistel_pii,
    "op4_direct_codes": op4_direct_codes,
    "op5_template_leaks": op5_template_leaks,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_simhash_bk": op7_simhash_bk,
    "op8_boosted_dom": op8_boosted_dom,
    "op9_cutting_stock": op9_cutting_stock,
    "op10_brown_classes": op10_brown_classes,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc_segments": op12_warc_segments,
    "op13_heap_kmeans": op13_heap_kmeans,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_prefix_trie": TRIE_SQL, "op12_warc_segments": WARC_SQL, "op13_heap_kmeans": CENTROID_SQL}
