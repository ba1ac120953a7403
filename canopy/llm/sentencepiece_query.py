"""op8: SentencePiece encoding and decoding over ``documents``."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers

from canopy.llm.registry import query
from canopy.llm.sentencepiece_bpe import coded_texts
from canopy.sources.tables import table

MODEL = "piece_bpe_32k.model"


def _digests(ids: str, decoded: str, n: int) -> tuple[int, str, str]:
    return n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded_texts(docs, public_tokenizers.path(MODEL), _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
