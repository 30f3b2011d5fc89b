"""tabprobe: table-understanding evaluation as Spark jobs."""

from tabprobe.operators.checks import check_contract, enforce, enforce_complete
from tabprobe.operators.conversations import render_conversations
from tabprobe.operators.ingest import (
    cells,
    first_tables,
    largest_tables,
    parse_tables,
    tables_from_rows,
    truncate_tables,
)
from tabprobe.operators.longform import serialise_rows
from tabprobe.operators.markup import control_positions, markup_sizes, overlapping_tokens
from tabprobe.operators.prompts import build_prompts, external_prompts, judge_prompts
from tabprobe.operators.resume import carry_over, combine, merge_latest, pending
from tabprobe.operators.sampling import sample_tables
from tabprobe.operators.scoring import score
from tabprobe.operators.selection import budget_report, first_complete, with_list_order
from tabprobe.operators.serialise import (
    build_instances,
    generate_instances,
    question_instances,
    serialise_tables,
)
from tabprobe.operators.summary import (
    parse_verdicts,
    row_metrics,
    summarise,
    summarise_all,
    summarise_pivot,
)
from tabprobe.operators.tasks import generate_tasks, unique_values, value_positions
from tabprobe.streaming.incremental import incremental_score

__all__ = [
    "budget_report", "build_instances", "build_prompts", "carry_over", "cells", "check_contract",
    "combine", "control_positions", "enforce", "enforce_complete", "external_prompts",
    "first_complete", "first_tables", "generate_instances", "generate_tasks", "incremental_score", "judge_prompts",
    "largest_tables", "markup_sizes", "merge_latest", "overlapping_tokens", "parse_tables",
    "parse_verdicts", "pending", "question_instances", "render_conversations", "row_metrics",
    "sample_tables", "score", "serialise_rows", "serialise_tables", "summarise", "summarise_all",
    "summarise_pivot", "tables_from_rows", "truncate_tables", "unique_values", "value_positions",
    "with_list_order",
]
