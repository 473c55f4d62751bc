"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from isochord.llm import queries_clustering as clustering
from isochord.llm import queries_decontamination as decontamination
from isochord.llm import queries_fill_middle as fill_middle
from isochord.llm import queries_lines_mix as lines_mix
from isochord.llm import queries_near_dedup as near_dedup
from isochord.llm import queries_packing as packing
from isochord.llm import queries_quality as quality
from isochord.llm import queries_secrets as secrets
from isochord.llm import queries_substrings as substrings
from isochord.llm import queries_tokens as tokens
from isochord.llm import queries_warc as warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_embedding_dedup": near_dedup.op2_embedding_dedup,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_quality": quality.op4_quality,
    "op5_simhash": near_dedup.op5_simhash,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_secrets": secrets.op7_secrets,
    "op8_source_mix": lines_mix.op8_source_mix,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_line_dedup": lines_mix.op10_line_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_packing": packing.op12_packing,
    "op13_clusters": clustering.op13_clusters,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_embedding_dedup": near_dedup.OP2_SQL,
    "op6_decontaminate": decontamination.OP6_SQL,
    "op8_source_mix": lines_mix.OP8_SQL,
    "op10_line_dedup": lines_mix.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op13_clusters": clustering.OP13_SQL,
}
