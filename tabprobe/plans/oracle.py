"""The catalogue's queries as standard SQL over the same tables, written separately."""

from __future__ import annotations

from tabprobe import fixed_values as fixed

ORDER_SORT = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
ORDER_HEADER = [
    "line", "part", "supplier", "quantity", "price", "discount", "tax", "returned", "status", "shipped",
]
CUSTOMER_HEADER = ["customer", "name", "balance", "segment"]
CONVERSATION_HEADER = ["turn", "role", "text"]


def quote(text: str) -> str:
    """A Python string as an SQL literal; line ends as chr() so that the SQL stays readable."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


def money(name: str) -> str:
    return f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"


def names(header: list[str]) -> str:
    return "[" + ", ".join(f"'{h}'" for h in header) + "]"


ORDER_CELLS = (
    "[CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
    f"{money('l_quantity')}, {money('l_extendedprice')}, {money('l_discount')}, {money('l_tax')}, "
    "l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')]"
)
CUSTOMER_CELLS = f"[CAST(c_custkey AS VARCHAR), c_name, {money('c_acctbal')}, c_mktsegment]"


def _corpus(key: str, table: str, sort: str, cells: str, header: list[str]) -> str:
    return f"""
lines AS (SELECT CAST({key} AS VARCHAR) AS table_id, CAST({key} AS BIGINT) AS pos,
    row_number() OVER (PARTITION BY {key} ORDER BY {sort}) AS rn, {cells} AS line FROM {table}),
t AS (SELECT table_id, min(pos) AS pos, {names(header)} AS header,
    list(line ORDER BY rn) AS rows, count(*) AS n_rows, {len(header)} AS n_cols
    FROM lines GROUP BY table_id)"""


T_ORD = _corpus("l_orderkey", "lineitem", ORDER_SORT, ORDER_CELLS, ORDER_HEADER)
T_NAT = _corpus("c_nationkey", "customer", "c_custkey", CUSTOMER_CELLS, CUSTOMER_HEADER)
T_CUST = _corpus("c_custkey // 20", "customer", "c_custkey", CUSTOMER_CELLS, CUSTOMER_HEADER)
T_CONV = _corpus(
    "conv_id", "conversations", "turn", "[CAST(turn AS VARCHAR), role, text]", CONVERSATION_HEADER
)

CELLS = """
cells AS (SELECT table_id, n_cols, rn - 1 AS r, unnest(range(len(line))) AS c, unnest(line) AS v
    FROM lines JOIN t USING (table_id))"""


# --- formats ----------------------------------------------------------------
def _csv_line(cell: str, row: str) -> str:
    return f"array_to_string(list_transform({row}, lambda v: {cell}), ',')"


_MINIMAL = (
    "CASE WHEN contains(v, ',') OR contains(v, '\"') OR contains(v, chr(10)) OR contains(v, chr(13)) "
    "THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END"
)
_QUOTED = "'\"' || replace(v, '\"', '\"\"') || '\"'"


def _lines(separator: str) -> str:
    return (
        f"array_to_string(list_concat([array_to_string(header, {separator})], "
        f"list_transform(rows, lambda r: array_to_string(r, {separator}))), chr(10))"
    )


def _csv(cell: str) -> str:
    return (
        f"array_to_string(list_concat([{_csv_line(cell, 'header')}], "
        f"list_transform(rows, lambda r: {_csv_line(cell, 'r')})), chr(13) || chr(10))"
    )


def _md() -> str:
    width = "greatest(length(header[j]), list_max(list_transform(rows, lambda q: length(q[j]))), 3)"
    line = "'| ' || array_to_string(list_transform({row}, lambda v, j: rpad(v, CAST(" + width + " AS INT), ' ')), ' | ') || ' |'"
    rule = "'| ' || array_to_string(list_transform(header, lambda v, j: repeat('-', " + width + ")), ' | ') || ' |'"
    return (
        f"array_to_string(list_concat([{line.format(row='header')}, {rule}], "
        f"list_transform(rows, lambda r: {line.format(row='r')})), chr(10))"
    )


def _facts(between: str, joiner: str) -> str:
    return f"array_to_string(list_transform(r, lambda v, j: header[j] || '{between}' || v), '{joiner}')"


FORMAT_SQL = {
    "tsv": _lines("chr(9)"),
    "md": _md(),
    "prose": f"array_to_string(list_transform(rows, lambda r, i: 'Row ' || i || ': ' || {_facts(' is ', ', ')} || '.'), ' ')",
    "csv": _csv(_MINIMAL),
    "csv_q": _csv(_QUOTED),
    "row_obj": f"array_to_string(list_transform(rows, lambda r, i: 'Row ' || i || ' | ' || {_facts('=', ' | ')}), chr(10))",
    "col_sep": _lines("' <COL> '"),
    "sec_sep": _lines("' § '"),
    "json": (
        "'[' || chr(10) || array_to_string(list_transform(rows, lambda r: '  {' || chr(10) || "
        "array_to_string(list_transform(r, lambda v, j: '    ' || CAST(to_json(header[j]) AS VARCHAR) || ': ' || "
        "CAST(to_json(v) AS VARCHAR)), ',' || chr(10)) || chr(10) || '  }'), ',' || chr(10)) || chr(10) || ']'"
    ),
    "html": (
        "'<table>' || chr(10) || '  <tr>' || chr(10) || array_to_string(list_transform(header, lambda h: "
        "'    <th>' || h || '</th>' || chr(10)), '') || '  </tr>' || chr(10) || "
        "array_to_string(list_transform(rows, lambda r: '  <tr>' || chr(10) || array_to_string(list_transform(r, "
        "lambda v: '    <td>' || v || '</td>' || chr(10)), '') || '  </tr>' || chr(10)), '') || '</table>'"
    ),
    "yaml": (
        "array_to_string(list_transform(rows, lambda r: '- ' || array_to_string(list_transform(r, lambda v, j: "
        "header[j] || ': ' || v), chr(10) || '  ')), chr(10))"
    ),
    "xml": (
        "'<table>' || chr(10) || array_to_string(list_transform(rows, lambda r, i: '  <row id=\"' || i || '\">' || "
        "chr(10) || array_to_string(list_transform(r, lambda v, j: '    <' || header[j] || '>' || v || '</' || "
        "header[j] || '>' || chr(10)), '') || '  </row>' || chr(10)), '') || '</table>'"
    ),
}


def format_query(fmt: str) -> str:
    corpus = T_CONV if fmt in ("csv", "csv_q", "json") else T_ORD
    return f"WITH {corpus} SELECT table_id, '{fmt}' AS fmt, {FORMAT_SQL[fmt]} AS table_text FROM t"


def texts(formats: list[str]) -> str:
    branches = [f"SELECT table_id, '{f}' AS fmt, {FORMAT_SQL[f]} AS table_text FROM t" for f in formats]
    return "texts AS (" + " UNION ALL ".join(branches) + ")"


def serialise_long() -> str:
    """Whole tables as text, cut into the parts of 50 rows again by row pieces."""
    header = names(CUSTOMER_HEADER)
    line_of = {
        "tsv": ("array_to_string(line, chr(9))", "chr(10)", "array_to_string(header, chr(9)) || chr(10)", "''"),
        "csv": (_csv_line(_MINIMAL, "line"), "chr(13) || chr(10)", _csv_line(_MINIMAL, "header") + " || chr(13) || chr(10)", "''"),
        "csv_q": (_csv_line(_QUOTED, "line"), "chr(13) || chr(10)", _csv_line(_QUOTED, "header") + " || chr(13) || chr(10)", "''"),
        "col_sep": ("array_to_string(line, ' <COL> ')", "chr(10)", "array_to_string(header, ' <COL> ') || chr(10)", "''"),
        "sec_sep": ("array_to_string(line, ' § ')", "chr(10)", "array_to_string(header, ' § ') || chr(10)", "''"),
        "prose": ("'Row ' || rn || ': ' || array_to_string(list_transform(line, lambda v, j: header[j] || ' is ' || v), ', ') || '.'", "' '", "''", "''"),
        "json": (
            "'  {' || chr(10) || array_to_string(list_transform(line, lambda v, j: '    ' || CAST(to_json(header[j]) AS VARCHAR) || ': ' || "
            "CAST(to_json(v) AS VARCHAR)), ',' || chr(10)) || chr(10) || '  }'",
            "',' || chr(10)", "'[' || chr(10)", "chr(10) || ']'",
        ),
        "yaml": ("'- ' || array_to_string(list_transform(line, lambda v, j: header[j] || ': ' || v), chr(10) || '  ')", "chr(10)", "''", "''"),
        "xml": (
            "'  <row id=\"' || rn || '\">' || chr(10) || array_to_string(list_transform(line, lambda v, j: '    <' || header[j] || '>' || v || '</' || "
            "header[j] || '>'), chr(10)) || chr(10) || '  </row>'",
            "chr(10)", "'<table>' || chr(10)", "chr(10) || '</table>'",
        ),
        "row_obj": (
            "'Row ' || rn || ' | ' || array_to_string(list_transform(line, lambda v, j: header[j] || '=' || v), ' | ')",
            "chr(10)", "''", "''",
        ),
        "html": (
            "'  <tr>' || chr(10) || array_to_string(list_transform(line, lambda v: '    <td>' || v || '</td>'), chr(10)) || chr(10) || '  </tr>'",
            "chr(10)",
            "'<table>' || chr(10) || '  <tr>' || chr(10) || array_to_string(list_transform(header, lambda v: '    <th>' || v || '</th>'), chr(10)) || chr(10) || '  </tr>' || chr(10)",
            "chr(10) || '</table>'",
        ),
        "md": (
            "'| ' || array_to_string(list_transform(line, lambda v, j: rpad(v, widths[j], ' ')), ' | ') || ' |'",
            "chr(10)",
            "'| ' || array_to_string(list_transform(header, lambda v, j: rpad(v, widths[j], ' ')), ' | ') || ' |' || chr(10) || "
            "'| ' || array_to_string(list_transform(header, lambda v, j: repeat('-', widths[j])), ' | ') || ' |' || chr(10)",
            "''",
        ),
    }
    branches = [
        f"""SELECT table_id, '{fmt}' AS fmt, part,
            CASE WHEN part = 0 THEN any_value({opening}) ELSE {joiner} END
            || string_agg({piece}, {joiner} ORDER BY rn)
            || CASE WHEN part = any_value(last_part) THEN {closing} ELSE '' END AS part_text
            FROM p GROUP BY table_id, part"""
        for fmt, (piece, joiner, opening, closing) in line_of.items()
    ]
    return f"""WITH {T_NAT},
w AS (SELECT table_id, {header} AS header, (max(rn) - 1) // 50 AS last_part,
    [CAST(greatest(length('customer'), max(length(line[1]))) AS INT), CAST(greatest(4, max(length(line[2]))) AS INT),
     CAST(greatest(7, max(length(line[3]))) AS INT), CAST(greatest(7, max(length(line[4]))) AS INT)] AS widths
    FROM lines GROUP BY table_id),
p AS (SELECT lines.table_id, rn, line, header, widths, last_part, (rn - 1) // 50 AS part FROM lines JOIN w USING (table_id))
""" + " UNION ALL ".join(branches)


# --- tasks ------------------------------------------------------------------
def _rank(kind: str, item: str) -> str:
    return f"row_number() OVER (PARTITION BY table_id ORDER BY md5('42:' || table_id || ':{kind}:' || {item}), {item})"


TASK_CTES = f"""{CELLS},
cell_picks AS (SELECT * FROM (SELECT *, {_rank('cell', '(r * n_cols + c)')} AS k FROM cells) WHERE k <= 3),
vals AS (SELECT table_id, v, min(r * n_cols + c) AS slot, count(*) AS n FROM cells GROUP BY table_id, v),
drawn AS (SELECT * FROM (SELECT *, {_rank('value', 'slot')} AS k FROM vals) WHERE k <= 3),
ambiguous AS (SELECT table_id, k, row_number() OVER (PARTITION BY table_id ORDER BY k) AS a FROM drawn WHERE n > 1),
spare AS (SELECT table_id, v, slot, {_rank('replacement', 'slot')} AS a FROM vals
    WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM drawn d WHERE d.table_id = vals.table_id AND d.slot = vals.slot)),
value_picks AS (SELECT table_id, k, v, slot FROM drawn WHERE n = 1
    UNION ALL SELECT s.table_id, m.k, s.v, s.slot FROM ambiguous m JOIN spare s USING (table_id, a)),
row_picks AS (SELECT * FROM (SELECT table_id, rn - 1 AS r, line, {_rank('row', '(rn - 1)')} AS k FROM lines) WHERE k <= 2),
col_ids AS (SELECT table_id, unnest(range(n_cols)) AS c FROM t),
col_picks AS (SELECT * FROM (SELECT table_id, c, {_rank('col', 'c')} AS k FROM col_ids) WHERE k <= 2),
all_tasks AS (
    SELECT table_id, 0 AS g, 1 AS k, 'size_detection' AS task, {quote(fixed.SIZE_QUESTION)} AS question,
        n_rows || ' rows, ' || n_cols || ' columns' AS gold FROM t
    UNION ALL SELECT p.table_id, 1, k, 'cell_lookup',
        'What value is in row ' || (r + 1) || ', column ''' || header[c + 1] || '''?', v
        FROM cell_picks p JOIN t USING (table_id)
    UNION ALL SELECT p.table_id, 2, k, 'reverse_lookup',
        'In which row and column does the value ''' || v || ''' appear? Answer exactly as: row N, column ''ColName''.',
        'row ' || (slot // t.n_cols + 1) || ', column ''' || header[slot % t.n_cols + 1] || ''''
        FROM value_picks p JOIN t USING (table_id)
    UNION ALL SELECT table_id, 3, k, 'row_retrieval', 'List all values in row ' || (r + 1) || ', one value per line.',
        array_to_string(line, chr(10)) FROM row_picks
    UNION ALL SELECT p.table_id, 4, k, 'col_retrieval',
        'List all values in the column ''' || any_value(header[p.c + 1]) || ''', one value per line.',
        string_agg(v, chr(10) ORDER BY cells.r)
        FROM col_picks p JOIN t USING (table_id) JOIN cells ON cells.table_id = p.table_id AND cells.c = p.c
        GROUP BY p.table_id, k),
"""


def tasks(kinds: list[str] | None = None) -> str:
    kept = "" if kinds is None else "WHERE task IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"""{TASK_CTES}
tasks AS (SELECT a.table_id, CAST(row_number() OVER (PARTITION BY a.table_id ORDER BY g, k) - 1 AS INT) AS task_seq,
    task, question, gold, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols
    FROM all_tasks a JOIN t USING (table_id) {kept})"""


def task_query(corpus: str, kinds: list[str] | None = None) -> str:
    return f"WITH {corpus}, {tasks(kinds)} SELECT * FROM tasks"


# --- prompts ----------------------------------------------------------------
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{_TOKEN}')) AS INT)"


_HEAD = "'<s>[INST] <<SYS>>' || chr(10) || " + quote(fixed.SYSTEM_PROMPT) + " || chr(10) || '<</SYS>>' || chr(10) || chr(10) || "
_ASK = " || chr(10) || '---' || chr(10) || 'Using only the table above, answer the question.' || chr(10) || "
_SHORT = "'Give a short answer: one word, number, or phrase. No explanation.'"
_LIST = "'List each value on a separate line. No extra text.'"
_IS_LIST = "task IN ('row_retrieval', 'col_retrieval')"


def _body(text: str, question: str) -> str:
    rule = f"CASE WHEN {_IS_LIST} THEN {_LIST} ELSE {_SHORT} END"
    return (
        f"'Table:' || chr(10) || {text}{_ASK}{rule} || chr(10) || chr(10) || 'Question: ' || {question} "
        "|| chr(10) || 'Answer:'"
    )


def _prompt_query(corpus: str, prompt: str, more: str = "") -> str:
    """Sums per table and format over all kinds and formats; ``more`` are CTEs that ``prompt`` reads, by format."""
    stops = [len("|".join(x)) for x in (fixed.STOP_STRINGS_LIST, fixed.STOP_STRINGS_QA)]

    def digest(text: str) -> str:
        return f"CAST(sum(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)) AS BIGINT)"

    return f"""WITH {corpus}, {tasks()}, {texts(list(FORMAT_SQL))}{more},
prompts AS (SELECT tasks.*, fmt, {prompt} AS prompt FROM tasks JOIN texts USING (table_id){" JOIN examples USING (fmt)" if more else ""})
SELECT table_id, fmt, count(*) AS n_prompts, count(*) FILTER (WHERE {_IS_LIST}) AS n_lists, CAST(sum({token_count('prompt')}) AS BIGINT) AS prompt_tokens,
    CAST(sum(CASE WHEN {_IS_LIST} THEN 256 ELSE 64 END) AS BIGINT) AS max_new_tokens, {digest('prompt')} AS prompt_digests,
    CAST(sum(CASE WHEN {_IS_LIST} THEN {stops[0]} ELSE {stops[1]} END) AS BIGINT) AS stop_chars
FROM prompts GROUP BY table_id, fmt"""


_ZERO_SHOT = _HEAD + _body("table_text", "question") + " || ' [/INST]'"


def one_shot() -> str:
    def by_task(part: int) -> str:
        return "CASE task " + " ".join(f"WHEN '{k}' THEN {quote(qa[part])}" for k, qa in fixed.EXAMPLE_QA.items()) + " END"

    rows = "[" + ", ".join(names(r) for r in fixed.EXAMPLE_ROWS) + "]"
    shown = " UNION ALL ".join(f"SELECT '{f}' AS fmt, {sql} AS example FROM e" for f, sql in FORMAT_SQL.items())
    prompt = (
        _HEAD + _body("example", by_task(0)) + f" || ' ' || {by_task(1)} || chr(10) || chr(10) || "
        + _body("table_text", "question") + " || ' [/INST]'"
    )
    return _prompt_query(T_ORD, prompt, f""",
e AS (SELECT {names(fixed.EXAMPLE_HEADER)} AS header, {rows} AS rows),
examples AS ({shown})""")


def questions() -> str:
    return f"""WITH {T_ORD}, {texts(['tsv', 'yaml'])},
q AS (SELECT table_id, 'wtq_qa' AS task, fmt, 'Which parts are in order ' || table_id || '?' AS question,
    list_transform(rows, lambda r: r[2]) AS parts, n_rows, n_cols, table_text FROM t JOIN texts USING (table_id)),
p AS (SELECT *, {_ZERO_SHOT} AS prompt FROM q)
SELECT table_id, task, fmt, array_to_string(parts, chr(10)) AS gold, CAST(to_json(parts) AS VARCHAR) AS answers,
    CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, {token_count('prompt')} AS prompt_tokens,
    md5(prompt) AS prompt_md5, md5({quote("|".join(fixed.STOP_STRINGS_QA))}) AS stop_md5 FROM p"""


CHAT_RENDER = """
WITH n AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before, lag(text) OVER w AS before_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, turn, role, CASE WHEN rn = 2 AND before = 'system'
    THEN '<<SYS>>' || chr(10) || before_text || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text ELSE text END AS content FROM n)
SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg(CASE role
    WHEN 'user' THEN '<s>[INST] ' || trim(content, ' ' || chr(9) || chr(10) || chr(13)) || ' [/INST]'
    WHEN 'assistant' THEN ' ' || trim(content, ' ' || chr(9) || chr(10) || chr(13)) || ' </s>' ELSE '' END, '' ORDER BY turn) AS prompt
FROM m GROUP BY conv_id"""

TEMPLATE_FILL = """
SELECT doc_id, md5(text || chr(10) || '{' || source || '} what does {context} ' || doc_id || ' say? {' || lang || '}') AS prompt_md5
FROM documents"""

MCQ = f"""WITH {T_CUST}
SELECT pos, 'Question: Which customer is in block ' || table_id || '?' || chr(10) || array_to_string(
    list_transform(rows, lambda r, i: chr(CAST(64 + i AS INT)) || '. ' || r[2]), chr(10)) || chr(10) || 'Answer:' AS text
FROM t"""

_DOC_PREDICTIONS = """
p AS (SELECT CAST(doc_id AS VARCHAR) AS table_id, lang AS task, source AS fmt, 'question ' || doc_id AS question,
    CAST(n_chars AS VARCHAR) AS gold, text AS raw FROM documents)"""


def judge_prompt(version: str) -> str:
    text = fixed.JUDGE_PROMPTS[version].rstrip("\n")
    sql = quote(text)
    for name, column in [("task", "task"), ("question", "question"), ("gold", "gold"), ("prediction", "raw")]:
        sql = sql.replace("{" + name + "}", f"' || {column} || '")
    sql = sql.replace("{{", "{").replace("}}", "}")
    # The chat layout strips the body; in suc_v1 the prediction itself comes last.
    body = f"rtrim({sql}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"""WITH {_DOC_PREDICTIONS}, q AS (SELECT *, '<s>[INST] ' || {body} || ' [/INST]' AS prompt FROM p)
SELECT table_id, task, fmt, 'raw' AS target_field, {token_count('prompt')} AS judge_prompt_tokens,
    md5(prompt) AS judge_prompt_md5 FROM q"""


# --- budgets and selection --------------------------------------------------
_DOC_PROMPTS = f"""
p AS (SELECT source AS table_id, lang AS task, CAST(doc_id AS VARCHAR) AS fmt, {token_count('text')} AS prompt_tokens FROM documents)"""

PROMPT_BUDGET = f"""WITH {_DOC_PROMPTS}
SELECT table_id, max(prompt_tokens) AS max_prompt_tokens_seen, count(*) FILTER (WHERE prompt_tokens > 1000) AS n_failing_instances,
    bool_and(prompt_tokens <= 1000) AS all_complete FROM p GROUP BY table_id"""
FAILING = f"WITH {_DOC_PROMPTS} SELECT * FROM p WHERE prompt_tokens > 1000"
MARK_LONG = f"""WITH {_DOC_PROMPTS} SELECT fmt, prompt_tokens,
    CASE WHEN prompt_tokens > 1000 THEN '[SKIPPED: ' || prompt_tokens || ' tokens > 1000]' END AS skip_note FROM p"""


def select_until_n() -> str:
    """A prompt's tokens are those of its table, its question and the rest: blanks stand between them."""
    kinds = ", ".join(f"('{k}')" for k in fixed.TASKS_PER_TABLE)
    return f"""WITH {T_ORD}, {tasks()}, {texts(list(FORMAT_SQL))},
x AS (SELECT table_id, fmt, {token_count('table_text')} AS nt FROM texts),
q AS (SELECT table_id, task, {token_count('question')} AS nq FROM tasks),
e AS (SELECT task, '' AS table_text, '' AS question FROM (VALUES {kinds}) v(task)),
b AS (SELECT task, {token_count(_ZERO_SHOT)} AS nb FROM e),
s AS (SELECT table_id, nt + nq + nb AS n FROM x JOIN q USING (table_id) JOIN b USING (task)),
r AS (SELECT table_id, pos, max(n) AS max_prompt_tokens_seen, count(*) FILTER (WHERE n > 700) AS n_failing_instances,
    bool_and(n <= 700) AS all_complete FROM s JOIN t USING (table_id) GROUP BY table_id, pos),
w AS (SELECT *, sum(CASE WHEN all_complete THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS complete FROM r)
SELECT table_id, pos, max_prompt_tokens_seen, n_failing_instances, all_complete FROM w
WHERE complete - CASE WHEN all_complete THEN 1 ELSE 0 END < 150"""


ORDER_BY_LIST = f"""WITH {T_ORD},
u AS (SELECT CAST(o_orderkey AS VARCHAR) AS table_id,
    row_number() OVER (ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) - 1 AS ord
    FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT t.table_id, CAST(n_rows AS INT) AS n_rows, coalesce(ord, 1000000000) AS ord FROM t LEFT JOIN u USING (table_id)"""

# --- extraction -------------------------------------------------------------
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _cut(text: str, stops: list[str]) -> str:
    for stop in stops:
        text = f"split_part({text}, {quote(stop)}, 1)"
    return text


def _strip(text: str) -> str:
    return f"trim({text}, {_SPACE})"


_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E]|\x{85}|\x{2028}|\x{2029}"
_SCALAR_CHARS = "chr(34) || chr(39) || '`.,;'"


def _tidy(text: str) -> str:
    return f"trim({_strip(text)}, {_SCALAR_CHARS})"


EXTRACT_SCALAR = f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Reasoning. Answer: ' || text ELSE '- key: ' || text END AS raw FROM documents),
c AS (SELECT doc_id, {_cut('raw', fixed.STOP_STRINGS_QA)} AS cut FROM d),
a AS (SELECT doc_id, {_strip("list_last(string_split(cut, 'Answer:'))")} AS body FROM c),
l AS (SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(body, '{_BREAKS}'), lambda x: {_tidy('x')}),
    lambda x: x <> '')[1], '') AS line FROM a),
k AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^-\\s+\\S[^:]*:\\s+')
    THEN {_tidy("regexp_extract(line, '^-\\s+\\S[^:]*:\\s+(.*)', 1)")} ELSE line END AS line FROM l)
SELECT doc_id, CASE WHEN length(line) <= 120 THEN line
    WHEN contains(line, ',') THEN {_tidy("split_part(line, ',', 1)")}
    WHEN contains(line, chr(9)) THEN {_tidy("split_part(line, chr(9), 1)")}
    WHEN contains(line, ' | ') THEN {_tidy("split_part(line, ' | ', 1)")}
    WHEN contains(line, ' § ') THEN {_tidy("split_part(line, ' § ', 1)")}
    WHEN contains(line, ' <COL> ') THEN {_tidy("split_part(line, ' <COL> ', 1)")}
    ELSE substr(line, 1, 120) END AS pred FROM k"""

EXTRACT_LIST = f"""
WITH c AS (SELECT conv_id, turn, {_cut('text', fixed.STOP_STRINGS_LIST)} AS cut FROM conversations),
a AS (SELECT conv_id, turn, {_strip("list_last(string_split(cut, 'Answer:'))")} AS body FROM c)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(body, '{_BREAKS}'),
    lambda x: trim({_strip('x')}, chr(34) || chr(39) || '`.,;-')), lambda x: x <> ''), chr(10)) AS pred FROM a"""

NEWLINES = """SELECT doc_id, md5(replace(text, chr(10), '\\n')) AS escaped_md5,
    md5(replace(replace(text, chr(10), '\\n'), '\\n', chr(10))) AS restored_md5 FROM documents"""

PARSE_VERDICT = """
WITH e AS (SELECT event_id, event_id % 8 AS k, event_type, props,
    CASE event_id % 8 WHEN 6 THEN '"TRUE"' WHEN 7 THEN '1' ELSE 'true' END AS correct,
    '{"content_correct": ' || CASE event_id % 8 WHEN 6 THEN '"TRUE"' WHEN 7 THEN '1' ELSE 'true' END
    || ', "overinclusive": false, "score": ' || CAST(round(value) AS INT) || ', "reason": "' || event_type || '", "extra": ' || props || '}' AS body,
    CAST(CAST(round(value) AS INT) AS DOUBLE) AS score FROM events),
x AS (SELECT *, CASE k WHEN 2 THEN body || ' ' || body WHEN 3 THEN '[' || body || ']' WHEN 4 THEN 'no verdict ' || props || ' }' END AS bad FROM e)
SELECT event_id, CASE WHEN bad IS NULL AND k <> 7 THEN true END AS content_correct,
    CAST(NULL AS BOOLEAN) AS content_partial, CAST(NULL AS BOOLEAN) AS format_correct,
    CASE WHEN bad IS NULL THEN false END AS overinclusive, CAST(NULL AS BOOLEAN) AS instruction_following_error,
    CASE WHEN bad IS NULL THEN score END AS score, coalesce(substr(bad, 1, 500), event_type) AS reason FROM x"""

# --- metrics ----------------------------------------------------------------
_V = """
v AS (SELECT doc_id, lang AS task, source AS fmt, quality = 1 AS cc, n_chars > 500 AS fc, toxic = 1 AS oi, n_chars > 2000 AS ie
    FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT doc_id, task, fmt, CAST(cc AS DOUBLE) AS relaxed_accuracy, CAST(cc AND NOT oi AS DOUBLE) AS accuracy_clean,
    CAST(cc AND NOT oi AND NOT ie AS DOUBLE) AS strict_accuracy, CAST(fc AS DOUBLE) AS format_correct_rate,
    CAST(oi AS DOUBLE) AS overinclusive_rate, CAST(ie AS DOUBLE) AS instruction_following_error_rate FROM v)"""


def _averages(rounded: bool = False) -> str:
    shape = "round_even(avg({m}), 4) AS {m}" if rounded else "avg({m}) AS {m}"
    return "count(*) AS n, " + ", ".join(shape.format(m=m) for m in fixed.SUMMARY_METRICS)


def pivot() -> str:
    columns = []
    for metric in ["n", *fixed.SUMMARY_METRICS]:
        for i in range(20):
            rows = f"FILTER (WHERE fmt = 'src{i}')"
            value = f"CAST(nullif(count(*) {rows}, 0) AS DOUBLE)" if metric == "n" else f"avg({metric}) {rows}"
            columns.append(f'{value} AS "src{i}_{metric}"')
    return f"WITH {_V} SELECT task, {', '.join(columns)} FROM m GROUP BY task"


# --- incremental runs -------------------------------------------------------
def judge_pending() -> str:
    prompt = judge_prompt("current").split("SELECT table_id, task, fmt, 'raw'")[0]
    return f"""{prompt} SELECT table_id, length(prompt) % 2 = 0 AS content_correct, CAST(NULL AS BOOLEAN) AS overinclusive,
    '{{"content_correct": ' || CAST(length(prompt) % 2 = 0 AS VARCHAR) || '}}' AS raw_judge FROM q
    WHERE NOT EXISTS (SELECT 1 FROM labels WHERE CAST(labels.doc_id AS VARCHAR) = q.table_id)"""


def judge_csv_runs() -> str:
    prompt = judge_prompt("current").split("SELECT table_id, task, fmt, 'raw'")[0]
    return f"""{prompt} SELECT CASE k % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'turned' ELSE 'stored' END AS run_id, table_id, task, fmt,
    length(prompt) % 2 = 0 AS content_correct, CASE k % 3 WHEN 1 THEN (SELECT count(*) FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 = 1) ELSE 0 END AS n_malformed
    FROM (SELECT *, CAST(table_id AS BIGINT) AS k FROM q) WHERE NOT (k % 3 = 1 AND k % 10 = 1)"""


# --- markup -----------------------------------------------------------------
_HTML = r"(?m)<[^>]+>|^[ \t]+|\n"
_COL_SEP_TOKENS = f"""
tok AS (SELECT table_id, regexp_extract_all({FORMAT_SQL['col_sep']}, '{_TOKEN}') AS tokens FROM t)"""


def token_overlap() -> str:
    return f"""WITH {T_ORD}, {_COL_SEP_TOKENS},
x AS (SELECT table_id, unnest(range(len(tokens))) AS i, unnest(tokens) AS token FROM tok)
SELECT table_id, count(*) AS n_markup_tokens, CAST(sum(i) AS BIGINT) AS sum_token_idx FROM x
WHERE token IN ('<', 'COL', '>') GROUP BY table_id"""


#: Positions drawn one by one from jobs q (table_id, key, random_seed, n, k): a list of places is folded into the list of positions.
_DRAWS = """
settled AS (SELECT table_id, key, random_seed, list_reduce(
    list_concat([CAST([] AS BIGINT[])], list_transform(range(n - k, n), lambda p:
        [p, CAST('0x' || substr(sha256(random_seed || ':' || key || ':' || p), 1, 12) AS BIGINT) % (p + 1)])),
    lambda s, x: list_append(s, CASE WHEN list_contains(s, x[2]) THEN x[1] ELSE x[2] END)) AS s FROM q)"""


def random_positions() -> str:
    return f"""WITH {T_ORD}, {_COL_SEP_TOKENS},
q AS (SELECT table_id, table_id AS key, CAST(len(tokens) AS BIGINT) AS n, least(n_rows, len(tokens)) AS k, CAST(unnest(range(42, 62)) AS INT) AS random_seed
    FROM tok JOIN t USING (table_id)), {_DRAWS},
c AS (SELECT table_id, 'random10pct' AS patch_group, CAST(random_seed AS VARCHAR) AS random_seed, array_to_string(list_sort(s), ',') AS positions FROM settled)
SELECT * FROM c UNION ALL SELECT table_id, 'format_late', NULL, NULL FROM t"""


def control_positions() -> str:
    return f"""WITH {T_ORD}, {tasks(['size_detection'])}, {texts(['col_sep'])},
p AS (SELECT table_id, task, fmt, question, {_ZERO_SHOT} AS prompt FROM tasks JOIN texts USING (table_id)),
tok AS (SELECT table_id, table_id || '|' || task || '|' || fmt || '|' || question AS key, regexp_extract_all(prompt, '{_TOKEN}') AS tokens FROM p),
x AS (SELECT table_id, key, unnest(range(len(tokens))) AS i, unnest(tokens) AS token, len(tokens) AS n FROM tok),
-- 'COL' and its brackets occur only in the table part; the brackets of <s>, <<SYS>> and <</SYS>> have other neighbours
y AS (SELECT *, token = 'COL' OR (token = '<' AND lead(token) OVER w = 'COL') OR (token = '>' AND lag(token) OVER w = 'COL') AS mark
    FROM x WINDOW w AS (PARTITION BY table_id ORDER BY i)),
b AS (SELECT table_id, count(*) FILTER (WHERE mark) AS budget FROM y GROUP BY table_id),
q AS (SELECT table_id, key, CAST(unnest(range(42, 62)) AS INT) AS random_seed, CAST(len(tokens) AS BIGINT) AS n, budget AS k FROM tok JOIN b USING (table_id)), {_DRAWS},
z AS (SELECT table_id, 'format_late' AS patch_group, CAST(NULL AS VARCHAR) AS random_seed, list(i ORDER BY i) AS s FROM y WHERE mark GROUP BY table_id
    UNION ALL SELECT table_id, 'random10pct', CAST(random_seed AS VARCHAR), list_sort(s) FROM settled)
SELECT table_id, patch_group, random_seed, CAST(len(s) AS INT) AS patch_positions, md5(array_to_string(s, ',')) AS positions_md5 FROM z"""


def control_resume() -> str:
    return f"""WITH {T_ORD}, {tasks(['row_retrieval', 'col_retrieval'])},
j AS (SELECT tasks.table_id, CAST(table_id AS BIGINT) AS o, task_seq, fmt, patch_group, seed FROM tasks, (VALUES ('col_sep'), ('html')) f(fmt),
    (SELECT 'random10pct' AS patch_group, CAST(unnest(range(42, 62)) AS INT) AS seed UNION ALL SELECT 'format_late', NULL)),
d AS (SELECT *, CASE WHEN seed IS NULL THEN o % 2 = 0 ELSE seed - 42 < o % 20 END AND (o + coalesce(seed, 0)) % 7 <> 0 AS done FROM j)
SELECT table_id, task_seq, fmt, patch_group, count(*) AS n_left, CAST(sum(seed) AS BIGINT) AS sum_seeds FROM d WHERE NOT done
GROUP BY table_id, task_seq, fmt, patch_group"""


def tasks_mt19937() -> str:
    return f"""WITH {T_ORD}, {CELLS},
u AS (SELECT table_id, count(*) FILTER (WHERE n = 1) AS n_unique FROM (SELECT table_id, v, count(*) AS n FROM cells GROUP BY table_id, v) GROUP BY table_id),
k AS (SELECT table_id, 1 AS a, least(3, n_rows * n_cols) AS b, least(3, n_unique) AS c, least(2, n_rows) AS d, least(2, n_cols) AS e FROM t JOIN u USING (table_id))
SELECT table_id, CAST(a AS BIGINT) AS n_size_detection, CAST(b AS BIGINT) AS n_cell_lookup, CAST(c AS BIGINT) AS n_reverse_lookup, CAST(d AS BIGINT) AS n_row_retrieval,
    CAST(e AS BIGINT) AS n_col_retrieval, CAST(a + b + c + d + e AS BIGINT) AS n_right, CAST(a + b + c + d + e AS BIGINT) AS n_different FROM k"""


def external_records() -> str:
    contexts = " UNION ALL ".join(f"SELECT '{fmt}' AS fmt, '{field[8]}' AS mark" for fmt, field in fixed.EXTERNAL_CONTEXTS.items())
    body = "'read ' || mark || substr(text, 1, 40) || ' then answer who is ' || source"
    return f"""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS sub_task_name, fmt, source AS gold,
    md5('<s>[INST] <<SYS>>' || chr(10) || {quote(fixed.EXTERNAL_SYSTEM_PROMPT)} || chr(10) || '<</SYS>>' || chr(10) || chr(10) || {body} || ' [/INST]') AS prompt_md5
    FROM documents, ({contexts}) c WHERE doc_id % 2 = 0"""


_SHOWN = "table_id, CAST(len(rows) AS INT) AS n_rows, CAST(len(header) AS INT) AS n_cols, CAST(to_json(header) AS VARCHAR) AS header, CAST(to_json(rows) AS VARCHAR) AS rows"

ORACLE: dict[str, str] = {
    "stored_tables": f"WITH {T_ORD} SELECT {_SHOWN}, pos, 'q' AS question, count(*) OVER () AS n_stored, CAST(42 AS BIGINT) AS seed FROM t",
    "stored_tasks": f"""WITH {T_ORD}, {tasks()} SELECT table_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INT) AS n_tasks,
        md5(string_agg(task || '|' || gold, chr(10) ORDER BY task_seq)) AS tasks_md5 FROM tasks GROUP BY table_id""",
    "stored_selection": f"""WITH {T_ORD}, u AS (SELECT CAST(o_orderkey AS VARCHAR) AS table_id,
        CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS ord FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT table_id, CAST(n_rows AS INT) AS n_rows, ord FROM t JOIN u USING (table_id)""",
    "stored_predictions": f"""WITH {_DOC_PREDICTIONS} SELECT run_id, table_id, task, fmt, md5(raw) AS raw_md5
        FROM p, (VALUES ('first'), ('second')) r(run_id) WHERE run_id = 'second' OR length(raw) % 5 <> 0""",
    "csv_predictions": f"""WITH {_DOC_PREDICTIONS} SELECT table_id, task, fmt, question, gold, 'p"p' || chr(10) || ',' AS prompt,
        CAST(NULL AS VARCHAR) AS pred, md5(raw) AS raw_md5 FROM p""",
    "stored_verdicts": """SELECT CAST(doc_id AS VARCHAR) AS table_id, lang AS task, source AS fmt, quality = 1 AS content_correct,
        quality = 0 AS content_partial, toxic = 1 AS overinclusive FROM documents LEFT JOIN labels USING (doc_id)""",
    "stored_summaries": f"""WITH {_V} SELECT CASE grouping(task, fmt) WHEN 0 THEN 'task_fmt' WHEN 2 THEN 'fmt' ELSE 'overall' END AS level,
        task, fmt, {_averages(True)} FROM m GROUP BY GROUPING SETS ((task, fmt), (fmt), ())""",
    "stored_external": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS prediction,
        TRUE AS in_order FROM documents""",
    "sql_formats": f"WITH {T_ORD} SELECT table_id, " + ", ".join(f"md5({sql}) AS fmt_{fmt}" for fmt, sql in FORMAT_SQL.items()) + " FROM t",
    "tables_from_rows": f"WITH {T_ORD} SELECT {_SHOWN} FROM t",
    "truncate_tables": f"""WITH {T_CUST}, s AS (SELECT table_id, header[1:3] AS header,
        list_transform(rows[1:15], lambda r: r[1:3]) AS rows FROM t) SELECT {_SHOWN} FROM s""",
    "parse_tables": f"""WITH {T_ORD},
        a AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS n FROM t WHERE pos % 5 <> 4),
        s AS (SELECT CASE WHEN pos % 5 = 3 THEN CAST(n AS VARCHAR) ELSE 't' || table_id END AS table_id, n AS pos,
            'order ' || table_id || '?' AS question, [rows[1][1]] AS answers, header, rows FROM a)
        SELECT {_SHOWN}, pos, question, CAST(to_json(answers) AS VARCHAR) AS answers FROM s""",
    "canonical_tables": f"""WITH {T_ORD}, a AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS n FROM t),
        s AS (SELECT 't' || table_id AS table_id, n AS pos, 'q' AS question, ['a'] AS answers, header, rows FROM a)
        SELECT {_SHOWN}, pos, question, CAST(to_json(answers) AS VARCHAR) AS answers FROM s""",
    "task_records": f"""WITH {T_ORD}, {tasks()} SELECT tasks.* FROM tasks
        WHERE table_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "tasks_mt19937_checked": tasks_mt19937(),
    "external_records": external_records(),
    "seeded_run": f"""WITH {T_ORD}, u AS (SELECT CAST(o_orderkey AS VARCHAR) AS table_id FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT 'second' AS run_id, table_id, fmt, 'a' || chr(10) || 'b' AS gold, '["a","b"]' AS answers, answer AS pred, answer AS raw
        FROM (SELECT table_id, CASE WHEN table_id IN (SELECT table_id FROM u) THEN 'first' ELSE 'second' END AS answer FROM t), (VALUES ('tsv'), ('md')) f(fmt)""",
    "plugged_tokens": """SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS INT) AS n_counted,
        CAST(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS INT) AS n_tokens, CAST(length(replace(text, ' ', '')) AS BIGINT) AS n_inside FROM documents""",
    "segment_overlap": token_overlap(),
    "control_resume": control_resume(),
    "stream_summaries": f"""WITH {_V} SELECT CASE grouping(task, fmt) WHEN 0 THEN 'task_fmt' WHEN 2 THEN 'fmt' ELSE 'overall' END AS level,
        task, fmt, {_averages()} FROM m GROUP BY GROUPING SETS ((task, fmt), (fmt), ())""",
    "cells": f"""WITH {T_ORD}, {CELLS} SELECT table_id, CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col_idx,
        {names(ORDER_HEADER)}[c + 1] AS col_name, v AS value FROM cells""",
    "largest_tables": f"""WITH {T_ORD} SELECT table_id, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols
        FROM t ORDER BY t.n_rows DESC, t.n_cols DESC, pos LIMIT 200""",
    "first_tables": f"WITH {T_ORD} SELECT table_id, pos FROM t ORDER BY pos LIMIT 300",
    "hash_sample_tables": f"""WITH {T_ORD} SELECT table_id,
        CAST(row_number() OVER (ORDER BY md5('42:' || table_id), table_id) - 1 AS INT) AS draw
        FROM t ORDER BY md5('42:' || table_id), table_id LIMIT 300""",
    "number_tables": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders",
    **{f"fmt_{fmt}": format_query(fmt) for fmt in FORMAT_SQL},
    "serialise_long": serialise_long(),
    "value_positions": f"""WITH {T_ORD}, {CELLS}, g AS (SELECT table_id, v, min(r * n_cols + c) AS slot, any_value(n_cols) AS n_cols,
        count(*) AS n_pos FROM cells GROUP BY table_id, v)
        SELECT table_id, v AS value, CAST(slot // n_cols AS INT) AS row_idx, CAST(slot % n_cols AS INT) AS col_idx, n_pos FROM g""",
    "unique_values": f"""WITH {T_ORD}, {CELLS} SELECT table_id, v AS value, CAST(min(r) AS INT) AS row_idx, CAST(min(c) AS INT) AS col_idx
        FROM cells GROUP BY table_id, v HAVING count(*) = 1""",
    "task_size_detection": task_query(T_CUST, ["size_detection"]),
    "task_cell_lookup": task_query(T_ORD, ["cell_lookup"]),
    "task_reverse_lookup": task_query(T_ORD, ["reverse_lookup"]),
    "task_row_col_retrieval": task_query(T_CUST, ["row_retrieval", "col_retrieval"]),
    "generate_tasks": task_query(T_ORD),
    "prompts_zero_shot": _prompt_query(T_ORD, _ZERO_SHOT),
    "prompts_one_shot": one_shot(),
    "prompts_questions": questions(),
    "chat_render": CHAT_RENDER,
    "template_fill": TEMPLATE_FILL,
    "mcq_prompt": MCQ,
    "judge_prompt_current": judge_prompt("current"),
    "judge_prompt_suc_v1": judge_prompt("suc_v1"),
    "prompt_budget": PROMPT_BUDGET,
    "failing_instances": FAILING,
    "mark_long_prompts": MARK_LONG,
    "select_until_n": select_until_n(),
    "order_by_id_list": ORDER_BY_LIST,
    "extract_scalar": EXTRACT_SCALAR,
    "extract_list": EXTRACT_LIST,
    "newline_escape": NEWLINES,
    "parse_verdict": PARSE_VERDICT,
    "row_metrics": f"WITH {_V} SELECT doc_id, accuracy_clean, {', '.join(fixed.SUMMARY_METRICS)} FROM m",
    "metrics_by_task_fmt": f"WITH {_V} SELECT task, fmt, {_averages()} FROM m GROUP BY task, fmt",
    "metrics_by_fmt": f"WITH {_V} SELECT fmt, {_averages(True)} FROM m GROUP BY fmt",
    "metrics_overall": f"WITH {_V} SELECT {_averages(True)} FROM m",
    "metrics_grouping_sets": f"""WITH {_V} SELECT CASE grouping(task, fmt) WHEN 0 THEN 'task_fmt' WHEN 2 THEN 'fmt' ELSE 'overall' END AS level,
        task, fmt, {_averages()} FROM m GROUP BY GROUPING SETS ((task, fmt), (fmt), ())""",
    "metrics_pivot": pivot(),
    "resume_pending": """SELECT doc_id, lang, source, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "resume_keep": """SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, CAST(NULL AS VARCHAR) AS lang FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "run_counts": """SELECT count(*) AS n_total, count(*) FILTER (WHERE quality IS NULL) AS n_pending,
        count(*) FILTER (WHERE quality IS NULL AND n_chars > 5000) AS n_skipped FROM documents LEFT JOIN labels USING (doc_id)""",
    "merge_last_wins": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) ELSE event_type END AS event_type,
        CASE WHEN event_id % 3 <> 0 THEN value * 2 ELSE value END AS value,
        CAST(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS INT) AS version FROM events""",
    "contract_checks": """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_ids,
        count(*) FILTER (WHERE NOT (l_linenumber <= 5)) AS not_in_first_five,
        count(*) FILTER (WHERE NOT (l_discount > 0)) AS no_discount FROM lineitem""",
    "missing_rows": "SELECT o_orderkey AS order_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "duplicate_ids": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "score_batches": """SELECT doc_id, CASE WHEN n_chars > 5000 THEN '[SKIPPED: ' || n_chars || ']'
        WHEN length(text) = 7 THEN NULL ELSE CAST(length(text) AS VARCHAR) END AS raw,
        CASE WHEN n_chars <= 5000 AND length(text) = 7 THEN 'seven characters' END AS error FROM documents""",
    "retry_failed": "SELECT doc_id, CAST(length(text) AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS error FROM documents",
    "judge_pending": judge_pending(),
    "judge_csv_runs": judge_csv_runs(),
    "counted_prompts": """SELECT doc_id, CAST(len(list_filter(string_split('Read this: ' || text, ' '), lambda w: w <> '')) AS INT) AS n_tokens,
        CAST(length(replace('Read this: ' || text, ' ', '')) AS BIGINT) AS n_inside, count(*) OVER (PARTITION BY text) AS n_copies FROM documents""",
    "hash_sample_half": f"""WITH {T_ORD}, d AS (SELECT table_id, CAST(row_number() OVER (ORDER BY md5('42:' || table_id), table_id) - 1 AS INT) AS draw
        FROM t) SELECT * FROM d WHERE draw < (SELECT count(*) // 2 FROM t)""",
    "stream_score": "SELECT doc_id, CAST(length(text) AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS error FROM documents",
    "markup_html": f"""SELECT page_id, CAST(length(html) AS INT) AS n_chars,
        CAST(length(html) - length(regexp_replace(html, '{_HTML}', '', 'g')) AS INT) AS n_markup_chars FROM pages""",
    "markup_json_colsep": f"""WITH {T_ORD}, {texts(['json', 'col_sep'])}
        SELECT table_id, fmt, CAST(length(table_text) AS INT) AS n_chars, CAST(CASE fmt
            WHEN 'json' THEN length(regexp_replace(table_text, '"([^"\\\\]|\\\\.)*"', '""', 'g'))
            ELSE length(table_text) - length(replace(replace(table_text, ' <COL> ', ''), chr(10), '')) END AS INT) AS n_markup_chars
        FROM texts""",
    "markup_spans": f"""SELECT page_id, count(*) AS n_spans, CAST(sum(length(s)) AS BIGINT) AS n_markup_chars,
        any_value(length(html)) - min(tail) AS last_end FROM (
            SELECT page_id, html, unnest(regexp_extract_all(html, '{_HTML}')) AS s,
                length(list_last(regexp_split_to_array(html, '{_HTML}'))) AS tail FROM pages) GROUP BY page_id""",
    "token_overlap": token_overlap(),
    "token_positions": token_overlap(),
    "random_positions": random_positions(),
    "control_positions": control_positions(),
    "seeded_keys": f"""WITH {_DOC_PREDICTIONS}, k AS (SELECT table_id, table_id || '|' || task || '|' || fmt || '|' || question AS instance_key FROM p)
        SELECT table_id, instance_key, sha256('42:' || instance_key) AS digest FROM k""",
}
