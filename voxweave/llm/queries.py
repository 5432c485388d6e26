"""The registered queries of this subpackage, and their SQL where it has any."""

from __future__ import annotations

from .align import op11_alignment
from .chat import OP10_SQL, op10_chat_format
from .decontam import op7_decontamination
from .langid import op13_langid
from .licences import op5_license_scan
from .lm import op9_lm_score
from .minhash import op8_minhash
from .mixing import OP3_SQL, op3_mixing
from .quality import OP4_SQL, op4_quality
from .repeats import op2_repeats
from .sharding import op1_sharding
from .variants import op12_variants
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_repeats": op2_repeats,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_minhash": op8_minhash,
    "op9_lm_score": op9_lm_score,
    "op10_chat_format": op10_chat_format,
    "op11_alignment": op11_alignment,
    "op12_variants": op12_variants,
    "op13_langid": op13_langid,
}

ORACLES = {
    "op3_mixing": OP3_SQL,
    "op4_quality": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op10_chat_format": OP10_SQL,
}
