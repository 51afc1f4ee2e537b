"""Queries opN_<name> and their SQL."""

from termloom.llm.bpe import op4_bpe
from termloom.llm.html_text import op5_html_text
from termloom.llm.language_id import op8_language_id
from termloom.llm.language_model import op7_language_model
from termloom.llm.line_dedup import op2_line_dedup
from termloom.llm.media_copies import op1_media_copies
from termloom.llm.near_dedup import op9_near_dedup
from termloom.llm.packing import op6_packing
from termloom.llm.simhash import op10_simhash
from termloom.llm.suffix_dedup import op3_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_media_copies, op2_line_dedup, op3_suffix_dedup, op4_bpe, op5_html_text, op6_packing, op7_language_model, op8_language_id, op9_near_dedup, op10_simhash)}
#: None of the ten is expressible in SQL that runs over whole tables; tests/llm has brute-force versions.
ORACLES: dict[str, str] = {}
