"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from echoform.llm import alignment, decontam, fingerprints, licences, manifest, mixing, ngram_join, pii, quality, suffix_dedup, toxicity, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mix": mixing.op2_mix,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_url_filter": urls.op5_url_filter,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_fingerprint": fingerprints.op8_fingerprint,
    "op9_licence_scan": licences.op9_licence_scan,
    "op10_quality": quality.op10_quality,
    "op11_pii": pii.op11_pii,
    "op12_alignment": alignment.op12_alignment,
    "op13_manifest": manifest.op13_manifest,
}
SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_mix": mixing.OP2_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op7_decontaminate": decontam.OP7_SQL,
    "op9_licence_scan": licences.oracle(),
    "op13_manifest": manifest.oracle(),
}
