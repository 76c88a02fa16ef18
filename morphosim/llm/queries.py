"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate, langmodel, licenses, minhash, onebit, packing, quality, secretscan, sharding, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_sharding": sharding.query,
    "op3_lm_scoring": langmodel.query,
    "op4_packing": packing.query,
    "op5_quality": quality.query,
    "op6_secrets": secretscan.query,
    "op7_near_dedup": minhash.query,
    "op8_decontamination": decontaminate.query,
    "op9_nearest": onebit.query,
    "op10_licenses": licenses.query,
}
ORACLES = {"op1_warc": warc.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op9_nearest": onebit.ORACLE, "op10_licenses": licenses.ORACLE}
