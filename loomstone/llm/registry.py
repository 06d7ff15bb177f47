"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from .op1_bpe import op1_bpe_transducer
from .op10_spans import op10_sentence_spans
from .op11_divergence import SQL as OP11_SQL
from .op11_divergence import op11_divergence_audit
from .op12_conversations import SQL as OP12_SQL
from .op12_conversations import op12_repair_conversations
from .op13_kneser_ney import SQL as OP13_SQL
from .op13_kneser_ney import op13_kneser_ney
from .op2_media import op2_mpeg_audio
from .op3_surrogates import op3_surrogates
from .op4_toxicity import op4_toxic_spans
from .op5_quality import op5_quality_network
from .op6_order_minhash import op6_order_minhash
from .op7_jaccard_join import op7_jaccard_join
from .op8_idfiles import op8_simple8b_files
from .op9_packing import op9_pack_sequences

ALL = (op1_bpe_transducer, op2_mpeg_audio, op3_surrogates, op4_toxic_spans, op5_quality_network, op6_order_minhash, op7_jaccard_join, op8_simple8b_files, op9_pack_sequences, op10_sentence_spans, op11_divergence_audit, op12_repair_conversations, op13_kneser_ney)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Only the operators on exact counts can be told in SQL whole; the others need the vocabulary, a trained model, keyed permutations or this package's hashes, and tests/llm holds each against brute force."""
    return {op11_divergence_audit.__name__: OP11_SQL, op12_repair_conversations.__name__: OP12_SQL, op13_kneser_ney.__name__: OP13_SQL}
