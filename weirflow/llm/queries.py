"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .archives import OP8_SQL, op8_archive
from .decontaminate import OP1_SQL, op1_decontaminate
from .html import op10_html
from .licenses import OP9_SQL, op9_licenses
from .media import op2_webp
from .mixing import OP7_SQL, op7_rake
from .quality import op4_quality
from .sharding import OP5_SQL, op5_hash_tree
from .simhash import op6_simhash
from .toxicity import op3_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_webp": op2_webp,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_hash_tree": op5_hash_tree,
    "op6_simhash": op6_simhash,
    "op7_rake": op7_rake,
    "op8_archive": op8_archive,
    "op9_licenses": op9_licenses,
    "op10_html": op10_html,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op5_hash_tree": OP5_SQL,
    "op7_rake": OP7_SQL,
    "op8_archive": OP8_SQL,
    "op9_licenses": OP9_SQL,
}
