"""Queries of this subpackage, by name, and the SQL of those that SQL expresses on whole tables."""

from __future__ import annotations

from stratagraph.llm.ann import op5_ann
from stratagraph.llm.boilerplate import OP6_SQL, op6_line_dedup
from stratagraph.llm.hardneg import OP13_SQL, op13_hard_negatives
from stratagraph.llm.infill import OP11_SQL, op11_infill
from stratagraph.llm.mpegts import op7_media_columns
from stratagraph.llm.neardup import op9_minhash
from stratagraph.llm.packing import op10_packing
from stratagraph.llm.pii import op8_pii
from stratagraph.llm.quality import op4_quality
from stratagraph.llm.repeats import op2_suffix_dedup
from stratagraph.llm.sentencepiece_codec import op3_sentencepiece
from stratagraph.llm.simhash import op12_simhash
from stratagraph.llm.warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_sentencepiece, op4_quality, op5_ann, op6_line_dedup, op7_media_columns, op8_pii, op9_minhash, op10_packing, op11_infill, op12_simhash, op13_hard_negatives)}
SQL = {"op1_warc": OP1_SQL, "op6_line_dedup": OP6_SQL, "op11_infill": OP11_SQL, "op13_hard_negatives": OP13_SQL}
