"""Schemas of the data sets, as DDL."""

TABLES = (
    "table_id STRING, pos BIGINT, question STRING, answers ARRAY<STRING>, "
    "header ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>"
)
TABLE_RECORD = (
    "id STRING, question STRING, answers ARRAY<STRING>, header ARRAY<STRING>, "
    "rows ARRAY<ARRAY<STRING>>"
)
TASKS = (
    "table_id STRING, task STRING, question STRING, gold STRING, n_rows INT, n_cols INT"
)
PREDICTIONS = (
    "table_id STRING, task STRING, fmt STRING, question STRING, gold STRING, "
    "n_rows INT, n_cols INT, prompt STRING, prompt_tokens INT, pred STRING, raw STRING, error STRING"
)
VERDICTS = (
    "table_id STRING, task STRING, fmt STRING, question STRING, gold STRING, "
    "target_field STRING, prediction_sent_to_judge STRING, content_correct BOOLEAN, "
    "content_partial BOOLEAN, format_correct BOOLEAN, overinclusive BOOLEAN, "
    "instruction_following_error BOOLEAN, score DOUBLE, reason STRING, raw_judge STRING"
)
EXTERNAL = (
    "id STRING, task_name STRING, sub_task_name STRING, instruction STRING, "
    "question_list ARRAY<STRING>, golden_answer_list ARRAY<STRING>, "
    "context STRUCT<context_html: STRING, context_latex: STRING, context_markdown: STRING>"
)
CHOICES = "question STRING, choices ARRAY<STRING>"
