"""Queries of the training-data operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from linkwright.llm.jpeg import op3_jpeg_media_columns
from linkwright.llm.lm import op8_subword_lattice_lm
from linkwright.llm.nndescent import op1_nn_descent_near_duplicates
from linkwright.llm.packing import op10_best_fit_packing
from linkwright.llm.pieces import op4_sentencepiece_viterbi
from linkwright.llm.quality import op5_quality_random_indexing
from linkwright.llm.sharding import op2_permutation_sharding
from linkwright.llm.simhash import op6_simhash_anchor_cover
from linkwright.llm.toxicity import op9_toxicity_kneser_ney
from linkwright.llm.warc import SQL_OP7, op7_warc_index_first

QUERIES = {f.__name__: f for f in (op1_nn_descent_near_duplicates, op2_permutation_sharding, op3_jpeg_media_columns, op4_sentencepiece_viterbi, op5_quality_random_indexing, op6_simhash_anchor_cover, op7_warc_index_first, op8_subword_lattice_lm, op9_toxicity_kneser_ney, op10_best_fit_packing)}
SQL: dict[str, str] = {"op7_warc_index_first": SQL_OP7}
