"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.chat import OP7_SQL, op7_chat
from graphloom.llm.decontaminate import OP4_SQL, op4_decontaminate
from graphloom.llm.html import op1_html
from graphloom.llm.licences import op10_licences
from graphloom.llm.pack import op3_pack
from graphloom.llm.pii import op6_pii
from graphloom.llm.quality import op8_quality
from graphloom.llm.simhash import op2_simhash
from graphloom.llm.suffixes import op9_suffixes
from graphloom.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_simhash": op2_simhash,
    "op3_pack": op3_pack,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_suffixes": op9_suffixes,
    "op10_licences": op10_licences,
}

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op7_chat": OP7_SQL}
