"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from millrace.llm.embeddings import op3_embeddings
from millrace.llm.lines import op2_line_dedup
from millrace.llm.media import op10_media
from millrace.llm.packing import op1_packing
from millrace.llm.secrets import op6_secrets
from millrace.llm.sentencepiece import op4_sentencepiece
from millrace.llm.simhash import op5_simhash
from millrace.llm.toxicity import op8_toxicity
from millrace.llm.urls import OP9_SQL, op9_urls
from millrace.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_embeddings": op3_embeddings,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_urls": op9_urls,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL, "op9_urls": OP9_SQL}
