"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from keyloom.llm.bpe import op7_bpe
from keyloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from keyloom.llm.html_text import op1_html_text
from keyloom.llm.licenses import op9_license_scan
from keyloom.llm.mixing import OP3_SQL, op3_mix_sources
from keyloom.llm.ngram_join import OP2_SQL, op2_ngram_join
from keyloom.llm.quality_rules import OP4_SQL, op4_quality_rules
from keyloom.llm.quality_cnn import op6_quality_cnn
from keyloom.llm.secrets import OP10_SQL, op10_secret_scan
from keyloom.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op9_license_scan": op9_license_scan,
    "op6_quality_cnn": op6_quality_cnn,
    "op1_html_text": op1_html_text,
    "op5_warc": op5_warc,
    "op2_ngram_join": op2_ngram_join,
    "op7_bpe": op7_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_rules": op4_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
}

ORACLE_SQL = {
    "op5_warc": OP5_SQL,
    "op2_ngram_join": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_secret_scan": OP10_SQL,
}
