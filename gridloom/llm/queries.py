"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_toxicity_kernel, op2_line_suffix, op3_temperature_mix, op4_url_markov, op5_language_ppm, op6_positional_index, op7_token_output, op8_media_flac, op9_superminhash, op10_lm_scoring

QUERIES = {
    "op1_toxicity_kernel": op1_toxicity_kernel.query,
    "op2_line_suffix": op2_line_suffix.query,
    "op3_temperature_mix": op3_temperature_mix.query,
    "op4_url_markov": op4_url_markov.query,
    "op5_language_ppm": op5_language_ppm.query,
    "op6_positional_index": op6_positional_index.query,
    "op7_token_output": op7_token_output.query,
    "op8_media_flac": op8_media_flac.query,
    "op9_superminhash": op9_superminhash.query,
    "op10_lm_scoring": op10_lm_scoring.query,
}

ORACLES = {
    "op2_line_suffix": op2_line_suffix.ORACLE,
    "op3_temperature_mix": op3_temperature_mix.ORACLE,
    "op6_positional_index": op6_positional_index.ORACLE,
}
