"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from tesora.llm import (
    divergence,
    fixity,
    forest,
    langid,
    lexical,
    linededup,
    maxent,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    wavelet,
)
from tesora.llm.base import Build

QUERIES: dict[str, Build] = {
    "op1_wavelet": wavelet.op1_wavelet,
    "op2_simhash": simhash.op2_simhash,
    "op3_fixity": fixity.op3_fixity,
    "op4_forest": forest.op4_forest,
    "op5_quality": quality.op5_quality,
    "op6_language": langid.op6_language,
    "op7_quality_votes": neighbours.op7_quality_votes,
    "op8_maxent": maxent.op8_maxent,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_lexical": lexical.op12_lexical,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {
    "op3_fixity": fixity.OP3_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_line_dedup": linededup.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
