"""The queries of this package, one for each operator, and SQL for those it can express."""

from __future__ import annotations

from .decontamination import OP6_SQL, op6_decontamination
from .language_id import op2_language_id
from .lm_scoring import op4_lm_scoring
from .mixing import op1_mixing
from .ngram_jaccard_join import op9_ngram_jaccard_join
from .quality_rules import op10_quality_rules
from .substring_dedup import op8_substring_dedup
from .toxicity import op7_toxicity
from .url_filter import OP5_SQL, op5_url_filter
from .warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_language_id, op3_warc, op4_lm_scoring, op5_url_filter, op6_decontamination, op7_toxicity, op8_substring_dedup, op9_ngram_jaccard_join, op10_quality_rules)
}
ORACLE_SQL = {"op3_warc": OP3_SQL, "op5_url_filter": OP5_SQL, "op6_decontamination": OP6_SQL}
