"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quarryloom.llm.chroma import op8_chroma
from quarryloom.llm.codes import OP11_SQL, op11_codes
from quarryloom.llm.decontaminate import OP5_SQL, op5_decontaminate
from quarryloom.llm.personal import op12_personal
from quarryloom.llm.pieces import op4_sentencepiece
from quarryloom.llm.quality import op3_quality
from quarryloom.llm.resampling import op13_resampling
from quarryloom.llm.secrets import op2_secrets
from quarryloom.llm.sharding import op7_sharding
from quarryloom.llm.simhash import op9_simhash
from quarryloom.llm.substrings import OP6_SQL, op6_substrings
from quarryloom.llm.toxicity import op10_toxicity
from quarryloom.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontaminate": op5_decontaminate,
    "op6_substrings": op6_substrings,
    "op7_sharding": op7_sharding,
    "op8_chroma": op8_chroma,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_codes": op11_codes,
    "op12_personal": op12_personal,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_substrings": OP6_SQL,
    "op11_codes": OP11_SQL,
}
