"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import oracles
from .decontaminate import op6_decontaminate
from .fmindex import op8_substring_dedup
from .fuzzyhash import op3_fuzzy_hash
from .induced import op9_suffix_dedup
from .mixing import op4_mix_sources
from .neardup import op10_near_duplicates
from .pseudonyms import op2_pseudonyms
from .quality import op5_quality
from .tokens import op7_token_records
from .warc import op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_pseudonyms, op3_fuzzy_hash, op4_mix_sources, op5_quality, op6_decontaminate, op7_token_records, op8_substring_dedup, op9_suffix_dedup, op10_near_duplicates)}
#: Compression, fingerprints, tokenizers, hash orders and keyed permutations aren't for SQL: tests hold those queries against plain loops.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": oracles.WARC,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op8_substring_dedup": oracles.SUBSTRINGS,
    "op9_suffix_dedup": oracles.SUFFIXES,
    "op10_near_duplicates": oracles.NEAR,
}
