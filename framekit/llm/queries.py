"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import mixing, url_filter
from .bpe import op4_bpe
from .cotrain import op7_cotrain
from .langid import op1_langid
from .lm_score import op2_lm_score
from .mixing import op8_mixing
from .order_minhash import op6_order_minhash
from .permutation_index import op10_ann
from .simhash import op5_simhash
from .toxicity import op3_toxicity
from .url_filter import op9_urls

QUERIES = {
    "op1_langid": op1_langid,
    "op2_lm_score": op2_lm_score,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_order_minhash": op6_order_minhash,
    "op7_cotrain": op7_cotrain,
    "op8_mixing": op8_mixing,
    "op9_urls": op9_urls,
    "op10_ann": op10_ann,
}

ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.ORACLE, "op9_urls": url_filter.oracle()}
