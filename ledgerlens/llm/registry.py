"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import licences, lines, media, merkle, mixing, neighbours, pieces, quality, sharding, simhash, tokens, trie, urls

_QUERIES = {
    "op1_mix_sources": (mixing.query, mixing.SQL),
    "op2_quality": (quality.query, None),
    "op3_simhash": (simhash.query, None),
    "op4_media_columns": (media.query, None),
    "op5_url_filter": (urls.query, None),
    "op6_token_files": (tokens.query, None),
    "op7_pieces": (pieces.query, None),
    "op8_line_dedup": (lines.query, None),
    "op9_licences": (licences.query, licences.SQL),
    "op10_nearest": (neighbours.query, None),
    "op11_merkle": (merkle.query, merkle.SQL),
    "op12_prefix_trie": (trie.query, None),
    "op13_shards": (sharding.query, None),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}
