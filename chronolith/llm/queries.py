"""The queries of this folder and their SQL, by name."""

from chronolith.llm.ann import op1_ann
from chronolith.llm.bpe import op3_bpe
from chronolith.llm.langid import op7_langid
from chronolith.llm.licenses import op12_licenses
from chronolith.llm.lm import op9_lm
from chronolith.llm.mixing import op8_mixing
from chronolith.llm.pii import op2_pii
from chronolith.llm.resampling import op13_resampling
from chronolith.llm.simhash import op10_simhash
from chronolith.llm.substring import op4_substring
from chronolith.llm.toolcalls import OP5_SQL, op5_toolcalls
from chronolith.llm.topk import OP6_SQL, op6_topk
from chronolith.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_ann, op2_pii, op3_bpe, op4_substring, op5_toolcalls, op6_topk, op7_langid, op8_mixing, op9_lm, op10_simhash,
        op11_whitening, op12_licenses, op13_resampling,
    )
}
SQL = {"op5_toolcalls": OP5_SQL, "op6_topk": OP6_SQL}
