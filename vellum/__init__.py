"""vellum: a Spark-native document-corpus and retrieval engine.

Every operator takes and returns a ``DataFrame``. Corpora, parts, chunks, index rows,
queries, sessions and evaluation cases are tables; the work runs as Spark SQL / DataFrame
plans, with Arrow-batched Python only where no built-in expression says the same thing.

The most used entry points are re-exported here; everything else lives in
``vellum.operators``, ``vellum.sources``, ``vellum.functions``, ``vellum.plans`` and
``vellum.streaming``.
"""

from vellum.operators.chunk import chunk, chunk_fixed, chunk_ids, chunk_recursive, chunk_semantic
from vellum.operators.classify import classify_keyword, classify_model, classify_parts
from vellum.operators.embed import embed, model_embedder
from vellum.operators.evaluate import evaluate
from vellum.operators.ivf import read_ivf, search_ivf, topk_similarity_ivf, write_ivf
from vellum.operators.search import context_assembly, topk_similarity, topk_similarity_lsh
from vellum.plans.answer import (chat_answers, chat_inputs, prepare_queries, rag_answer, rag_prompts, retrieve,
                                 title_answers)
from vellum.plans.build import build_knowledge_base, index_rows
from vellum.session import get_spark
from vellum.sources.files import scan_corpus
from vellum.sources.index_store import open_index, reset_index, update_index

__version__ = "0.1.0"

__all__ = [
    "build_knowledge_base", "chat_answers", "chat_inputs", "chunk", "chunk_fixed", "chunk_ids",
    "chunk_recursive", "chunk_semantic", "classify_keyword", "classify_model",
    "classify_parts", "context_assembly", "embed", "evaluate", "get_spark", "index_rows",
    "model_embedder", "open_index", "prepare_queries", "rag_answer", "rag_prompts",
    "read_ivf", "reset_index", "retrieve", "scan_corpus", "search_ivf", "title_answers", "topk_similarity",
    "topk_similarity_ivf", "topk_similarity_lsh", "update_index", "write_ivf",
]
