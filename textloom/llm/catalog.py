"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_embedding_dedup as op1_module
from . import op2_url_filter, op3_chat
from . import op5_secrets as op5_module
from . import op6_jaccard as op6_module
from .op1_embedding_dedup import op1_embedding_dedup
from .op2_url_filter import op2_url_filter as op2
from .op3_chat import op3_chat as op3
from .op4_toxicity import op4_toxicity
from .op5_secrets import op5_secrets
from .op6_jaccard import op6_jaccard
from .op7_decontaminate import op7_decontaminate
from .op8_packing import op8_packing
from .op9_lm import op9_lm
from .op10_language import op10_language
from .op11_merkle import SQL as OP11_SQL
from .op11_merkle import op11_merkle
from .op12_licenses import SQL as OP12_SQL
from .op12_licenses import op12_licenses
from .op13_runs import SQL as OP13_SQL
from .op13_runs import op13_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_url_filter": op2,
    "op3_chat": op3,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_jaccard": op6_jaccard,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_lm": op9_lm,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_licenses": op12_licenses,
    "op13_runs": op13_runs,
}
SQL: dict[str, str] = {
    "op1_embedding_dedup": op1_module.SQL, "op2_url_filter": op2_url_filter.SQL, "op3_chat": op3_chat.SQL, "op5_secrets": op5_module.SQL, "op6_jaccard": op6_module.SQL,
    "op11_merkle": OP11_SQL,
    "op12_licenses": OP12_SQL,
    "op13_runs": OP13_SQL,
}
