"""The queries of this subpackage and their SQL."""

from . import fill_in, lines, media, mixing, ngram_join, packing, pieces, quality_classifier, quality_rules, spelling, substrings, suffixes, url_filters

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_fill_in_middle": fill_in.op11_fill_in_middle,
    "op12_mixing": mixing.op12_mixing,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {
    "op2_substring_dedup": substrings.OP2_SQL,
    "op3_suffix_array_dedup": suffixes.OP3_SQL,
    "op4_ngram_jaccard_join": ngram_join.OP4_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
    "op11_fill_in_middle": fill_in.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
}
