"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from rolemeter.llm import audit, exact, fingerprints, licenses, manifest, mixing, packing, quality, secrets, simhash, tokens, toxicity, urls
from rolemeter.llm.shared import shipped

_QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_tokens": tokens.op2_tokens,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact": exact.op8_exact,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_urls": urls.op10_urls,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_manifest": manifest.op12_manifest,
    "op13_quality": quality.op13_quality,
}

REGISTRY = {name: shipped(query) for name, query in _QUERIES.items()}

ORACLE = {"op5_mixing": mixing.OP5_SQL, "op8_exact": exact.OP8_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_manifest": manifest.OP12_SQL, "op13_quality": quality.OP13_SQL}
