"""The queries of the package, and the SQL of those that SQL can express."""

from __future__ import annotations

from riskweave.llm import automaton, html_text, lines, mixing, packing, periodic, perplexity, pii, quality, simhash, sketch, substrings, variants

QUERIES = {
    "op1_html": html_text.op1_html,
    "op2_lines": lines.op2_lines,
    "op3_mixing": mixing.op3_mixing,
    "op4_pii": pii.op4_pii,
    "op5_sketch": sketch.op5_sketch,
    "op6_substrings": substrings.op6_substrings,
    "op7_simhash": simhash.op7_simhash,
    "op8_perplexity": perplexity.op8_perplexity,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op11_variants": variants.op11_variants,
    "op12_automaton": automaton.op12_automaton,
    "op13_periodic": periodic.op13_periodic,
}

SQL: dict[str, str] = {}
