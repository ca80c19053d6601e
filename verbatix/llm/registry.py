"""Queries of this package, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import mixing, topk_search, url_filter
from .decontaminate import op7_decontaminate
from .jaccard_join import op8_jaccard_join
from .language_id import op6_language_id
from .secret_scan import op10_secret_scan
from .surrogates import op3_pii_surrogates
from .token_codes import op1_token_codes
from .toxicity import op9_toxicity

QUERIES = {
    "op1_token_codes": op1_token_codes,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_poisson_mix": mixing.op4_poisson_mix,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op4_poisson_mix": mixing.ORACLE,
    "op5_topk_search": topk_search.ORACLE,
}
