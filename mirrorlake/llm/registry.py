"""The queries of this subpackage and their DuckDB twins."""

from . import decontaminate, extract, jaccard, licences, lines, mixing, quality, rules, secrets, substrings

_ALL = {
    "op1_quality_rules": rules,
    "op2_html_extraction": extract,
    "op3_ngram_jaccard": jaccard,
    "op4_decontamination": decontaminate,
    "op5_mixing": mixing,
    "op6_quality_classifier": quality,
    "op7_secret_scan": secrets,
    "op8_license_scan": licences,
    "op9_line_dedup": lines,
    "op10_suffix_dedup": substrings,
}


def queries():
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql():
    return {name: module.ORACLE for name, module in _ALL.items() if getattr(module, "ORACLE", None)}
