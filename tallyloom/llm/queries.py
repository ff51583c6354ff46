"""Registered training-data queries and their SQL."""

from __future__ import annotations

from tallyloom.llm import bpe, contexttree, gif, langid, mixing, ngramratio, quality, rans, simhash, spelling, toxicity, urlrange, whitening


def queries() -> dict:
    return {"op8_mixing": mixing.op8_mixing, "mixing_quotas": mixing.mixing_quotas, "op1_quality": quality.op1_quality, "op5_langid": langid.op5_langid, "op4_llr": ngramratio.op4_llr, "op7_simhash": simhash.op7_simhash, "op9_rans": rans.op9_rans, "op10_bpe": bpe.op10_bpe, "op2_gif": gif.op2_gif, "op3_toxicity": toxicity.op3_toxicity, "op6_url_filter": urlrange.op6_url_filter, "op11_contexttree": contexttree.op11_contexttree, "op12_spelling": spelling.op12_spelling, "op13_whitening": whitening.op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op4_llr": ngramratio.OP4_SQL, "op6_url_filter": urlrange.OP6_SQL, "mixing_quotas": mixing.QUOTAS_SQL}
