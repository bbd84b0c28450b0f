"""Prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section headers of the prompt.
INSTRUCTION_HEADER = "### Instruction:\n"
INPUT_HEADER = "\n\n### Input:\n"
RESPONSE_HEADER = "\n\n### Response:\n"


def inference_prompt(instruction: Column, chat: Column) -> Column:
    """Prompt that ends where the answer begins."""
    return F.concat(
        F.lit(INSTRUCTION_HEADER), instruction, F.lit(INPUT_HEADER), chat, F.lit(RESPONSE_HEADER))


def training_prompt(instruction: Column, chat: Column, response: Column) -> Column:
    return F.concat(inference_prompt(instruction, chat), response)


def completion_start(instruction: Column, chat: Column) -> Column:
    """Characters before the scored part; counted from the parts, since a chat may quote a header."""
    return F.length(inference_prompt(instruction, chat))


def first_candidate(candidates: Column) -> Column:
    """The first of several candidate answers, null when there is none."""
    return F.try_element_at(candidates, F.lit(1))
