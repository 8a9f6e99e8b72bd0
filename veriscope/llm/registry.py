"""The queries of this subpackage and the SQL of those that SQL can express."""

from veriscope.llm.ann import op8_ann
from veriscope.llm.bpe import op5_bpe
from veriscope.llm.brown import op7_brown
from veriscope.llm.langid import op9_crf
from veriscope.llm.mixing import OP3_SQL, op3_mixing
from veriscope.llm.pii import op2_pii
from veriscope.llm.quality import OP1_SQL, op1_quality
from veriscope.llm.secrets import op4_secrets
from veriscope.llm.simhash import op6_simhash
from veriscope.llm.suffix import OP10_SQL, op10_suffix

QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_brown": op7_brown,
    "op8_ann": op8_ann,
    "op9_crf": op9_crf,
    "op10_suffix": op10_suffix,
}
ORACLE: dict[str, str] = {
    "op1_quality": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op10_suffix": OP10_SQL,
}
