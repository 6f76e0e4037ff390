"""A PySpark-native engine for document corpora and verifiable answers."""

from pagemill.config import EngineConfig
from pagemill.engine import ablate, analyze_queries, answer_and_verify, answer_queries, build_index, evaluate_pipelines, ingest_blocks, open_index, report, search
from pagemill.operators.answer import Corpus

__all__ = ["Corpus", "EngineConfig", "ablate", "analyze_queries", "answer_and_verify", "answer_queries", "build_index", "evaluate_pipelines", "ingest_blocks", "open_index", "report", "search"]
