"""The registered queries of this subpackage and their SQL."""

from . import language, licenses, lz, media, merkle, mixing, packing, periods, pieces, quality, simhash, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language": language.op2_language,
    "op3_media": media.op3_media,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_fingerprints": lz.op5_fingerprints,
    "op6_quality": quality.op6_quality,
    "op7_licenses": licenses.op7_licenses,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_pieces": pieces.op11_pieces,
    "op12_periods": periods.op12_periods,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op7_licenses": licenses.ORACLE, "op13_merkle": merkle.ORACLE}
