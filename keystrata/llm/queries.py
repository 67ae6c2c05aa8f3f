"""The driver's queries for the training-data operators, and their SQL."""

from __future__ import annotations

from keystrata.llm.binary_output import op7_binary_output
from keystrata.llm.chat_format import OP10_SQL, op10_chat_format
from keystrata.llm.decontamination import OP2_SQL, op2_decontamination
from keystrata.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from keystrata.llm.html_extraction import op6_html_extraction
from keystrata.llm.near_dedup import op3_near_dedup
from keystrata.llm.packing import op5_packing
from keystrata.llm.quality import op9_quality_classifier
from keystrata.llm.secret_scan import op1_secret_scan
from keystrata.llm.url_filter import OP4_SQL, op4_url_filter


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_decontamination": op2_decontamination,
        "op3_near_dedup": op3_near_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_packing": op5_packing,
        "op6_html_extraction": op6_html_extraction,
        "op7_binary_output": op7_binary_output,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    """For the others: trained, hashed or freely chosen results; tests hold them against brute force."""
    return {"op2_decontamination": OP2_SQL, "op4_url_filter": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op10_chat_format": OP10_SQL}
