"""The operators' queries by name, with SQL where it can express them."""

from __future__ import annotations

from . import chat, compaction, decontam, divergence, langid, licenses, lines, media, ngrams, packing, quality, simhash, urls

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_media_columns": media.op5_media_columns,
    "op6_language_id": langid.op6_language_id,
    "op7_url_filters": urls.op7_url_filters,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_file_compaction": compaction.op11_file_compaction,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_ngram_join": ngrams.op13_ngram_join,
}

ORACLES = {
    "op7_url_filters": urls.oracle(),
    "op8_chat_formatting": chat.oracle(),
    "op11_file_compaction": compaction.oracle(),
    "op12_source_divergence": divergence.oracle(),
}
