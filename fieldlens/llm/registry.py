"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from .bpe import op1_bpe
from .html_text import op7_html_text
from .langid import op3_language_id
from .minhash import op5_near_duplicates
from .neighbours import SQL as NEIGHBOURS_SQL
from .neighbours import op9_nearest_neighbours
from .packing import op8_packing
from .prefixes import SQL as TRIE_SQL
from .prefixes import op11_conversation_trie
from .quality import SQL as QUALITY_SQL
from .quality import op6_quality_rules
from .repeats import op10_repeated_passages
from .rollups import op2_token_counts
from .simhash import op12_simhash
from .warc import SQL as WARC_SQL
from .warc import op4_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_warc": WARC_SQL,
    "op6_quality_rules": QUALITY_SQL,
    "op9_nearest_neighbours": NEIGHBOURS_SQL,
    "op11_conversation_trie": TRIE_SQL,
}
