"""The registered queries as SQL for DuckDB, written independently of the operators."""

from tallyloom.functions import fixed_values as fv
from tallyloom.operators.tokens import VOCABULARY
from tallyloom.plans import queries as q

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {text(fv.WHITESPACE)})"


def round_even(expr: str, digits: int) -> str:
    """printf rounds the exact binary value."""
    return f"CAST(printf('%.{digits}f', ({expr})::DOUBLE) AS DOUBLE)"


def seeded(row_id: str, seed: int = fv.SEED) -> str:
    return f"('0x' || substr(sha256('{seed}:' || {row_id}::VARCHAR), 1, 15))::BIGINT"


def exact_mean(expr: str) -> str:
    return f"(sum(({expr})::DECIMAL(18,9))::DOUBLE / count({expr})::DOUBLE)"


def with_(*names: str) -> str:
    """The WITH clause of the named views and everything they need."""
    wanted: list[str] = []

    def add(name):
        needs, _ = VIEWS[name]
        for n in needs:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in wanted) + "\n"


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
USER = "('user', 'human')"
ASSISTANT = "('assistant', 'gpt', 'model')"
GAP = "chr(10) || chr(10)"


def said(roles: str) -> str:
    return f"coalesce(string_agg(t, {GAP} ORDER BY turn) FILTER (WHERE r IN {roles} AND t <> ''), '')"


def prompt(expert: str) -> str:
    return (
        f"{text(fv.INSTRUCTION_HEADER)} || {strip('instruction')} || "
        f"CASE WHEN input <> '' THEN {text(fv.CONTEXT_HEADER)} || {strip('input')} ELSE '' END || "
        f"{text(fv.ANSWER_RULE.format(expert=expert))}"
    )


SYSTEM = text(fv.SYSTEM_PROMPTS[q.DOMAIN])
TRAIN_PROMPT = prompt(fv.EXPERT[q.DOMAIN, "train"])


def chatml(role: str, content: str) -> str:
    return f"'{fv.CHATML_OPEN}' || {role} || chr(10) || {content} || '{fv.CHATML_CLOSE}' || chr(10)"


def token_list(expr: str) -> str:
    return rf"regexp_extract_all({expr}, '[\p{{L}}\p{{N}}]+|[^\t\n\x0b\f\r \p{{L}}\p{{N}}]')"


def id_list(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {VOCABULARY})"


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, ' '), '')"


def filled(value: str, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {value})"


L = fv.MAX_LENGTH

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "turns": ((), f"SELECT conv_id, turn, lower(role) r, {strip('text')} t FROM conversations"),
    "instr": (
        ("turns",),
        f"SELECT conv_id AS id, {said(USER)} AS instruction, {said("('system')")} AS input, "
        f"{said(ASSISTANT)} AS output FROM turns GROUP BY conv_id",
    ),
    "requests": (
        (),
        f"""SELECT request_id, model, level, micros, success, total_time,
              CASE WHEN success THEN waited ELSE 0.0::DOUBLE END AS ttft,
              CASE WHEN success THEN k ELSE 0 END AS output_tokens,
              CASE WHEN success AND total_time - waited > 0 THEN k::DOUBLE / (total_time - waited) ELSE 0.0::DOUBLE END AS tps
            FROM (SELECT *, waited + k::DOUBLE / 10.0::DOUBLE AS total_time
                  FROM (SELECT event_id AS request_id, 'm' || (user_id % 3) AS model, (1 << (user_id % 4)::INTEGER)::BIGINT AS level,
                          epoch_us(ts) AS micros, event_type <> 'error' AS success, value / 1000.0::DOUBLE AS waited, {K} AS k
                        FROM events))""",
    ),
    "walls": (
        ("requests",),
        "SELECT model, level, (max(micros) - min(micros))::DOUBLE / 1000000.0::DOUBLE AS wall FROM requests WHERE level > 1 GROUP BY ALL",
    ),
    "ranked": (
        ("requests",),
        """SELECT *, row_number() OVER (PARTITION BY model, level ORDER BY ttft) - 1 AS rt,
             row_number() OVER (PARTITION BY model, level ORDER BY total_time) - 1 AS rl,
             count(*) OVER (PARTITION BY model, level) AS n
           FROM requests WHERE success""",
    ),
    "lines": (
        (),
        f"""SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) AS micros,
              CASE event_type
                WHEN 'view' THEN 'data: {{"choices":[{{"delta":{{"content":"t' || {K} || '"}}}}]}}'
                WHEN 'click' THEN 'data: {{"choices":[{{"delta":{{"content":"","reasoning_content":"r' || {K} || '"}}}}]}}'
                WHEN 'purchase' THEN 'data: {{"choices":[],"usage":{{"completion_tokens":' || {K} || '}}}}'
                WHEN 'signup' THEN ': keep-alive ' || {K}
                ELSE 'data: {{bad' END AS line
            FROM events
            UNION ALL
            SELECT user_id, count(*), max(epoch_us(ts)), 'data: [DONE]' FROM events GROUP BY user_id""",
    ),
    "chunks": (
        ("lines",),
        """SELECT request_id, seq, micros,
             coalesce(json_extract_string(j, '$.choices[0].delta.content'), '') <> ''
               OR coalesce(json_extract_string(j, '$.choices[0].delta.reasoning_content'), '') <> ''
               OR coalesce(json_extract_string(j, '$.choices[0].delta.reasoning'), '') <> '' AS has_token,
             CAST(json_extract_string(j, '$.usage.completion_tokens') AS BIGINT) AS usage_tokens
           FROM (SELECT l.*, CASE WHEN json_valid(substr(line, 7)) THEN substr(line, 7)::JSON END AS j
                 FROM lines l JOIN (SELECT request_id, min(seq) AS stop FROM lines WHERE line = 'data: [DONE]' GROUP BY 1) d USING (request_id)
                 WHERE line LIKE 'data: %' AND seq < stop)
           WHERE j IS NOT NULL""",
    ),
    "progress": (
        (),
        f"""SELECT user_id AS run_id, epoch_us(ts) AS micros, {K} AS k,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY user_id) AS max_steps,
              (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::DOUBLE / 1000000.0::DOUBLE AS elapsed
            FROM events""",
    ),
    "eta": (
        ("progress",),
        """SELECT *, CASE WHEN elapsed > 0 THEN elapsed * (max_steps::DOUBLE - step::DOUBLE) / step::DOUBLE END AS eta FROM progress""",
    ),
    "catalog": (
        (),
        """SELECT n_nationkey AS pos, n_name AS id, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS gpus,
             'region ' || n_regionkey || ' | key ' || n_nationkey AS description FROM nation""",
    ),
    "by_nation": ((), f"SELECT event_id AS request_id, 'NATION_' || (user_id % 30) AS model, {K} AS k FROM events"),
    "alias_docs": (
        (),
        f"""SELECT doc_id, source, {strip('text')} AS instruction,
              CASE lang WHEN 'fr' THEN {strip('source')} WHEN 'de' THEN n_chars::VARCHAR ELSE '' END AS input,
              CASE WHEN lang IN ('fr', 'de') THEN '' ELSE {strip('source')} END AS output FROM documents""",
    ),
    "keyed": ((), f"SELECT *, sha256({strip('text')} || {text(fv.KEY_SEPARATOR)} || lang || {text(fv.KEY_SEPARATOR)}) AS key FROM documents"),
    "shuffled": ((), f"SELECT *, row_number() OVER (ORDER BY {seeded('doc_id')}, doc_id) - 1 AS pos FROM documents"),
    "placed": ((), "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents"),
    "texts": (
        ("instr",),
        f"""SELECT *, {chatml("'system'", SYSTEM)} || {chatml("'user'", TRAIN_PROMPT)} AS opening, {strip('output')} AS answer FROM instr""",
    ),
    "toks": (
        ("texts",),
        f"""SELECT id, least(len({token_list(f"opening || '{fv.CHATML_OPEN}assistant' || chr(10)")}), {L}) AS prompt_len,
              {id_list(token_list("opening || " + chatml("'assistant'", "answer")))} AS full_ids FROM texts""",
    ),
    "feat": (
        ("toks",),
        f"""SELECT *, least(prompt_len, length) AS masked FROM
            (SELECT id, prompt_len, full_ids[1:{L}] AS ids, least(len(full_ids), {L}) AS length, len(full_ids) > {L} AS was_truncated FROM toks)""",
    ),
    "labelled": (
        ("feat",),
        f"SELECT *, list_concat({filled('-100', 'masked')}, ids[masked + 1:length]) AS labels FROM feat",
    ),
    "splits": (
        ("instr",),
        f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {seeded('id')}, id) <= ceil({q.FRACTION}::DOUBLE * count(*) OVER ())
              THEN 'validation' ELSE 'train' END AS split FROM instr""",
    ),
    "streaks": (
        ("requests",),
        """SELECT *, CASE WHEN success THEN 0 ELSE count(*) FILTER (WHERE NOT success) OVER (PARTITION BY model, level, oks ORDER BY micros, request_id) END AS streak
           FROM (SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY model, level ORDER BY micros, request_id) AS oks FROM requests)""",
    ),
}

SUMMARY = f"""SELECT model, level, count(*) AS requests_total, count(*) FILTER (WHERE success) AS requests_ok,
  count(*) FILTER (WHERE NOT success) AS requests_failed,
  {round_even(exact_mean('CASE WHEN success THEN ttft END') + ' * 1000', 1)} AS ttft_avg_ms,
  {round_even(exact_mean('CASE WHEN success THEN total_time END'), 3)} AS latency_avg_s,
  {round_even("sum(output_tokens) FILTER (WHERE success)::DOUBLE / nullif(count(*) FILTER (WHERE success), 0)::DOUBLE", 1)} AS tokens_per_resp_avg,
  (sum(output_tokens) FILTER (WHERE success))::BIGINT AS tokens_per_resp_total,
  {round_even(exact_mean('CASE WHEN success THEN tps END'), 2)} AS tps_per_request_avg,
  max(total_time) FILTER (WHERE success) AS longest
  FROM requests GROUP BY model, level"""

RANKS = f"""SELECT model, level,
  {round_even("(max(ttft) FILTER (WHERE rt = (n - 1) // 2) + max(ttft) FILTER (WHERE rt = n // 2)) / 2.0::DOUBLE * 1000", 1)} AS ttft_median_ms,
  {round_even("max(ttft) FILTER (WHERE rt = least(n - 1, floor(n::DOUBLE * 0.95::DOUBLE))) * 1000", 1)} AS ttft_p95_ms,
  {round_even("(max(total_time) FILTER (WHERE rl = (n - 1) // 2) + max(total_time) FILTER (WHERE rl = n // 2)) / 2.0::DOUBLE", 3)} AS latency_median_s
  FROM ranked GROUP BY model, level"""

VIEWS["sums"] = (("requests",), SUMMARY)
VIEWS["ranks"] = (("ranked",), RANKS)


def speed(seconds: str) -> str:
    return round_even(f"CASE WHEN {seconds} > 0 THEN tokens_per_resp_total::DOUBLE / ({seconds}) ELSE 0.0::DOUBLE END", 2)


def aborts(limit: int) -> str:
    return (
        with_("streaks")
        + f""", stops AS (SELECT model, level, min({{'m': micros, 'i': request_id}}) AS abort FROM streaks WHERE streak >= {limit} GROUP BY ALL),
        firsts AS (SELECT model, min(level) AS stop FROM stops GROUP BY ALL),
        counted AS (SELECT r.model, r.level, count(*) AS requests,
            count(*) FILTER (WHERE abort IS NULL OR {{'m': r.micros, 'i': r.request_id}} <= abort) AS done, max(abort.i) AS abort_id
          FROM requests r LEFT JOIN stops s ON r.model = s.model AND r.level = s.level GROUP BY ALL)
        SELECT c.model, level, CASE WHEN level > stop THEN 'not_run' WHEN abort_id IS NOT NULL THEN 'aborted' ELSE 'completed' END AS outcome,
          CASE WHEN stop IS NULL OR level <= stop THEN abort_id END AS abort_id,
          CASE WHEN stop IS NULL OR level <= stop THEN done ELSE 0 END AS done,
          CASE WHEN stop IS NULL OR level <= stop THEN requests - done ELSE requests END AS unstarted
        FROM counted c LEFT JOIN firsts f ON c.model = f.model"""
    )


def duration(s: str) -> str:
    w = f"floor({s})::BIGINT"
    return f"""CASE WHEN {s} IS NULL OR {s} <= 0 THEN 'unknown'
      WHEN {w} >= 3600 THEN ({w} // 3600)::VARCHAR || 'h' || lpad(({w} % 3600 // 60)::VARCHAR, 2, '0') || 'm'
      WHEN {w} >= 60 THEN ({w} // 60)::VARCHAR || 'm' || lpad(({w} % 60)::VARCHAR, 2, '0') || 's'
      ELSE {w}::VARCHAR || 's' END"""


def following(k: int) -> str:
    return f"CASE WHEN step < max_steps AND (step // {k} + 1) * {k} <= max_steps THEN (step // {k} + 1) * {k} END"


def chunked(size: int) -> str:
    return f"""SELECT *, pos // {size} + 1 AS part, CASE WHEN n <= {size} THEN ''
      ELSE 'part' || lpad((pos // {size} + 1)::VARCHAR, greatest(3, length(ceil(n / {size}.0::DOUBLE)::BIGINT::VARCHAR))::INTEGER, '0') END AS label FROM placed"""


def batches(order: str) -> str:
    return f"(row_number() OVER (ORDER BY {order}) - 1) // {q.BATCH}"


def padded(longest: str) -> str:
    return f"(ceil({longest} / {fv.PAD_MULTIPLE}.0::DOUBLE) * {fv.PAD_MULTIPLE})::BIGINT"


ORACLES.update(
    {
        "scan_json": f"SELECT doc_id, {strip('text')} AS instruction, '' AS input, {strip('source')} AS output FROM documents",
        "source_counts": "SELECT source, count(*) AS rows FROM documents GROUP BY source",
        "prompt_lines": rf"""SELECT doc_id, line_no, {strip('l')} AS line FROM
            (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS ls FROM documents))
            WHERE {strip('l')} <> ''""",
        "chunk_manifest": with_("placed")
        + f"SELECT part, label, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({chunked(q.MANIFEST_CHUNK)}) GROUP BY ALL",
        "results_doc": with_("requests")
        + """SELECT model, 'benchmark_results_' || model AS file_name, count(*) AS levels,
              string_agg(level || ':' || ok || ':' || tokens, ',' ORDER BY level) AS results
            FROM (SELECT model, level, count(*) AS ok, sum(output_tokens)::BIGINT AS tokens FROM requests WHERE success GROUP BY ALL) GROUP BY model""",
        "sse_events": with_("chunks") + "SELECT * FROM chunks",
        "alias_coalesce": with_("alias_docs") + "SELECT doc_id, instruction, input, output FROM alias_docs",
        "canonical_text": f"""SELECT 'documents' AS source, doc_id AS id, {strip('text')} AS text FROM documents
            UNION ALL SELECT 'events', event_id, replace(props, ' ', '') FROM events""",
        "empty_predicate": "SELECT doc_id, doc_id % 8 IN (0, 1, 2, 6) OR (doc_id % 8 = 7 AND text = '') AS empty, doc_id % 8 IN (0, 1, 2, 3, 4, 6) OR (doc_id % 8 = 7 AND text = '') AS falsy FROM documents",
        "chat_pair": with_("instr") + "SELECT id AS conv_id, instruction, output FROM instr",
        "normalize": with_("instr", "alias_docs")
        + """SELECT id, 'conversations' AS source_file, instruction, '' AS input, output FROM instr
            UNION ALL SELECT doc_id, source, instruction, input, output FROM alias_docs""",
        "calib_dispatch": with_("instr")
        + f"""SELECT 'conversations' AS source, conv_id AS id,
              CASE conv_id % 4
                WHEN 0 THEN string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) || 'assistant: ' || any_value(output) || chr(10)
                WHEN 1 THEN string_agg(role || ': ' || text || chr(10), '' ORDER BY turn)
                WHEN 2 THEN string_agg(CASE WHEN role IN {USER} THEN 'user' ELSE 'assistant' END || ': ' || text || chr(10), '' ORDER BY turn)
                ELSE 'user: ' || any_value(instruction) || chr(10) || 'assistant: ' || any_value(output) || chr(10) END AS text
            FROM conversations c JOIN instr i ON c.conv_id = i.id GROUP BY conv_id
            UNION ALL SELECT 'documents', doc_id, text FROM documents""",
        "alpaca": with_("instr") + "SELECT id, instruction, input, output FROM instr",
        "sharegpt": with_("instr")
        + f"SELECT id, 'system,human,gpt' AS speakers, {SYSTEM} AS system, {prompt(fv.EXPERT[q.DOMAIN, 'export'])} AS human, {strip('output')} AS gpt FROM instr",
        "user_prompt_text": with_("instr")
        + f"SELECT id, {prompt(fv.EXPERT['finance', 'export'])} AS finance_export, {TRAIN_PROMPT} AS finance_train, {prompt(fv.EXPERT['cyber', 'train'])} AS cyber_train FROM instr",
        "message_list": with_("instr")
        + f"""SELECT id, 'system,user,assistant' AS roles, {SYSTEM} || chr(10) || {TRAIN_PROMPT} || chr(10) || {strip('output')} AS contents,
              'system:text,user:text' AS parts FROM instr""",
        "render_plain": "SELECT conv_id, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "render_chatml": f"SELECT conv_id, string_agg({chatml('role', 'text')}, '' ORDER BY turn) || '{fv.CHATML_OPEN}assistant' || chr(10) AS text FROM conversations GROUP BY conv_id",
        "role_map": f"SELECT conv_id, turn, CASE WHEN role IN {USER} THEN 'user' ELSE 'assistant' END AS role FROM conversations",
        "union_sources": """SELECT source AS source_file, doc_id AS id, 0::BIGINT AS part, text FROM documents
            UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations""",
        "content_key": with_("keyed") + "SELECT doc_id, key FROM keyed",
        "dedupe": with_("keyed")
        + "SELECT doc_id, lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM keyed) WHERE rn = 1",
        "sample_random": with_("shuffled") + f"SELECT doc_id, pos, lang, text FROM shuffled WHERE pos < {q.SAMPLE}",
        "head": f"SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT {q.HEAD}",
        "sample_stride": with_("placed")
        + f"""SELECT doc_id, pos, lang, text FROM placed WHERE n <= {q.STRIDE} OR pos IN
            (SELECT floor(i::DOUBLE * ((SELECT count(*) FROM documents)::DOUBLE / {q.STRIDE}.0::DOUBLE)) FROM range({q.STRIDE}) t(i))""",
        "shuffle": with_("shuffled") + "SELECT doc_id, pos, lang FROM shuffled",
        "train_valid_split": with_("splits") + "SELECT id, split, instruction FROM splits",
        "train_valid_tail": with_("placed")
        + f"SELECT doc_id, CASE WHEN pos >= n - ceil({q.FRACTION}::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split FROM placed",
        "chunk_assign": with_("placed") + f"SELECT doc_id, part, label, lang FROM ({chunked(q.CHUNK)})",
        "tokenize": with_("toks") + f"SELECT id, prompt_len, {joined('full_ids')} AS full_ids FROM toks",
        "loss_mask": with_("labelled")
        + f"""SELECT id, {joined('ids')} AS input_ids, {joined(filled('1', 'length'))} AS attention_mask, {joined('labels')} AS labels,
              was_truncated, length FROM labelled""",
        "truncation_report": with_("feat", "splits")
        + "SELECT split, count(*) FILTER (WHERE was_truncated) AS truncated, count(*) AS total FROM feat JOIN splits USING (id) GROUP BY split",
        "trainable": with_("feat") + "SELECT id, length FROM feat WHERE length > prompt_len",
        "stage_counts": with_("feat", "splits")
        + "SELECT split, count(*) AS before, count(*) FILTER (WHERE length > prompt_len) AS after FROM feat JOIN splits USING (id) GROUP BY split",
        "pad_batches": with_("labelled")
        + f"""SELECT id, batch_id, width AS padded_length, {joined(f"list_concat(ids, {filled(str(q.PAD_ID), 'width - length')})")} AS input_ids,
              {joined(f"list_concat({filled('1', 'length')}, {filled('0', 'width - length')})")} AS attention_mask,
              {joined(f"list_concat(labels, {filled('-100', 'width - length')})")} AS labels
            FROM (SELECT *, {padded('max(length) OVER (PARTITION BY batch_id)')} AS width FROM (SELECT *, {batches('id')} AS batch_id FROM labelled))""",
        "length_batches": with_("feat") + f"SELECT id, length, {batches('length, id')} AS batch_id FROM feat WHERE length > prompt_len",
        "padding_report": with_("feat")
        + " UNION ALL ".join(
            f"""SELECT batch_id, count(*) AS rows, {padded('max(length)')} AS padded_length, ({padded('max(length)')} * count(*) - sum(length))::BIGINT AS padding, '{name}' AS grouping
            FROM (SELECT *, {batches(order)} AS batch_id FROM feat) GROUP BY batch_id"""
            for name, order in (("arrival", "id"), ("length", "length, id"))
        ),
        "calibration_set": f"""WITH talks AS (SELECT conv_id, string_agg({chatml('role', 'text')}, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id
              ORDER BY conv_id LIMIT {fv.CALIBRATION_ROWS}),
            ids AS (SELECT conv_id, {id_list(token_list('t'))}[1:{fv.CALIBRATION_LENGTH}] AS ids FROM talks)
            SELECT conv_id, len(ids) AS length, {joined('ids')} AS input_ids FROM ids""",
        "request_metrics": with_("lines", "chunks")
        + f""", spans AS (SELECT request_id, min(micros) AS s, coalesce(min(micros) FILTER (WHERE line = 'data: [DONE]'), max(micros)) AS e FROM lines GROUP BY 1),
            agg AS (SELECT request_id, min(micros) FILTER (WHERE has_token) AS f, count(*) FILTER (WHERE has_token) AS n,
                arg_max(usage_tokens, seq) FILTER (WHERE usage_tokens IS NOT NULL) AS u FROM chunks GROUP BY 1),
            m AS (SELECT request_id, s, e, coalesce(f, e) AS f, coalesce(n, 0) AS n, CASE WHEN u > 0 THEN u ELSE coalesce(n, 0) END AS toks FROM spans LEFT JOIN agg USING (request_id))
            SELECT request_id, {round_even('(f - s)::DOUBLE / 1000000.0::DOUBLE', 6)} AS ttft, {round_even('(e - s)::DOUBLE / 1000000.0::DOUBLE', 6)} AS total_time,
              toks AS output_tokens, {round_even('CASE WHEN e > f THEN toks::DOUBLE / ((e - f)::DOUBLE / 1000000.0::DOUBLE) ELSE 0.0::DOUBLE END', 6)} AS tokens_per_sec, n AS chunk_count FROM m""",
        "derived_metrics": f"""WITH t AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + round_even(value * 1000.0::DOUBLE, 0)::BIGINT AS f0, event_type, {K} AS k FROM events),
            u AS (SELECT event_id, s, k, f0 + k * 100000 AS e, CASE WHEN event_type <> 'error' THEN f0 ELSE f0 + k * 100000 END AS f FROM t)
            SELECT event_id, {round_even('(f - s)::DOUBLE / 1000000.0::DOUBLE', 6)} AS ttft, {round_even('(e - s)::DOUBLE / 1000000.0::DOUBLE', 6)} AS total_time,
              {round_even('CASE WHEN e > f THEN k::DOUBLE / ((e - f)::DOUBLE / 1000000.0::DOUBLE) ELSE 0.0::DOUBLE END', 6)} AS tokens_per_sec FROM u""",
        "status_counts": with_("sums") + "SELECT model, level, requests_total, requests_ok, requests_failed FROM sums",
        "level_summary": with_("sums", "ranks", "walls")
        + f"""SELECT s.model, s.level, requests_total, requests_ok, requests_failed, ttft_avg_ms, ttft_median_ms, ttft_p95_ms, latency_avg_s, latency_median_s,
              tokens_per_resp_avg, tokens_per_resp_total, tps_per_request_avg,
              CASE WHEN requests_ok > 0 THEN {speed("CASE WHEN coalesce(wall, 0) > 0 THEN wall ELSE longest END")} END AS tps_aggregate,
              CASE WHEN requests_ok = 0 THEN NULL WHEN coalesce(wall, 0) > 0 THEN 'wall' ELSE 'max_latency' END AS basis,
              CASE WHEN requests_ok = 0 THEN '{fv.ALL_FAILED}' END AS error
            FROM sums s LEFT JOIN ranks r ON s.model = r.model AND s.level = r.level LEFT JOIN walls w ON s.model = w.model AND s.level = w.level""",
        "p95_index": with_("ranked")
        + "SELECT model, level, max(ttft) AS ttft_p95 FROM ranked WHERE rt = least(n - 1, floor(n::DOUBLE * 0.95::DOUBLE)) GROUP BY ALL",
        "throughput": with_("sums", "walls")
        + f"""SELECT s.model, s.level, coalesce(tokens_per_resp_total, 0) AS tokens_per_resp_total,
              {speed("CASE WHEN coalesce(wall, 0) > 0 THEN wall ELSE longest END")} AS tps_aggregate,
              CASE WHEN coalesce(wall, 0) > 0 THEN 'wall' ELSE 'max_latency' END AS basis
            FROM sums s LEFT JOIN walls w ON s.model = w.model AND s.level = w.level""",
        "all_failed": with_("requests")
        + f"""SELECT model, level, success AS ok, count(*) AS requests_total, count(*) FILTER (WHERE NOT success) AS requests_failed,
              CASE WHEN success THEN sum(output_tokens)::BIGINT END AS tokens_per_resp_total,
              CASE WHEN success THEN {round_even('CASE WHEN max(total_time) > 0 THEN sum(output_tokens)::DOUBLE / max(total_time) ELSE 0.0::DOUBLE END', 2)} END AS tps_aggregate,
              CASE WHEN NOT success THEN '{fv.ALL_FAILED}' END AS error FROM requests GROUP BY model, level, success""",
        "comparison": with_("sums", "ranks")
        + f"""SELECT s.model, s.level, printf('%.1fms', ttft_avg_ms) AS ttft_avg, printf('%.1fms', ttft_p95_ms) AS ttft_p95, printf('%.3fs', latency_avg_s) AS latency_avg,
              printf('%.1f', tokens_per_resp_avg) AS tokens_per_resp, printf('%.2f', tps_per_request_avg) AS tps_request,
              printf('%.2f', {speed('longest')}) AS tps_aggregate
            FROM sums s JOIN ranks r ON s.model = r.model AND s.level = r.level
            WHERE requests_ok > 0 AND s.model IN (SELECT model FROM sums GROUP BY model HAVING count(*) > 1) ORDER BY 1, 2""",
        "request_plan": f"""WITH p AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark),
            i AS (SELECT level::BIGINT AS level, unnest(range(greatest((SELECT count(*) FROM benchmark), 2 * level))) AS request_no FROM (SELECT unnest({q.LEVELS}) AS level))
            SELECT level, request_no, item_id, text FROM i JOIN p ON request_no % n = pos""",
        "failure_streak": aborts(3),
        "failure_streak_long": aborts(6),
        "failure_runs": with_("streaks") + "SELECT request_id, model, level, streak FROM streaks",
        "resume_levels": with_("requests")
        + f"""SELECT model, level, count(*) AS planned, CASE WHEN level <= {q.CHECKPOINT_LEVEL} AND model <> 'm1' THEN 'reused' ELSE 'run' END AS action,
              CASE WHEN level <= {q.CHECKPOINT_LEVEL} AND model <> 'm1' THEN (sum(output_tokens) FILTER (WHERE success))::BIGINT END AS stored_tokens
            FROM requests GROUP BY model, level""",
        "leaderboard": with_("sums")
        + f""", firsts AS (SELECT * FROM sums s WHERE level = (SELECT min(level) FROM sums t WHERE t.model = s.model)),
            models AS (SELECT 'm' || n_nationkey AS model, n_regionkey <> 4 AS started, n_nationkey % 4 <> 3 AS doc FROM nation WHERE n_nationkey < 20)
            SELECT m.model, CASE WHEN started AND doc AND f.model IS NOT NULL THEN printf('%.1fms', ttft_avg_ms) ELSE 'N/A' END AS ttft_avg,
              CASE WHEN started AND doc AND f.model IS NOT NULL THEN printf('%.2f t/s', tps_per_request_avg) ELSE 'N/A' END AS tps_request,
              CASE WHEN started AND doc AND f.model IS NOT NULL THEN printf('%.2f t/s', {speed('longest')}) ELSE 'N/A' END AS tps_aggregate,
              CASE WHEN NOT started THEN 'FAILED' WHEN NOT doc THEN 'NO RESULTS' ELSE 'SUCCESS' END AS status
            FROM models m LEFT JOIN firsts f ON m.model = f.model""",
        "catalog_parse": with_("catalog") + "SELECT id, gpus, description FROM catalog",
        "catalog_lookup": with_("by_nation", "catalog")
        + f"""SELECT request_id, model, coalesce(c.gpus, CASE WHEN model IN {q.SPECIAL} THEN {fv.SPECIAL_GPUS} END, 1) AS gpus
            FROM by_nation r LEFT JOIN catalog c ON r.model = c.id""",
        "layered_override": with_("by_nation", "catalog")
        + f"""SELECT request_id, coalesce(CASE WHEN k % 5 = 0 THEN (k * 100)::VARCHAR END, (c.gpus * 16384)::VARCHAR, '{fv.STOCK_MAX_LEN}') AS max_len,
              coalesce(CASE WHEN c.gpus > 1 THEN (c.gpus * 8)::VARCHAR END, '{fv.STOCK_MAX_SEQS}') AS max_seqs
            FROM by_nation r LEFT JOIN catalog c ON r.model = c.id""",
        "training_plan": with_("instr")
        + """SELECT examples, 16::BIGINT AS effective_batch, per_epoch AS steps_per_epoch, 3.0::DOUBLE AS planned_epochs, per_epoch * 3 AS total_steps,
              per_epoch * 3 // 5 AS eval_count, 0::BIGINT AS save_count
            FROM (SELECT count(*) AS examples, greatest(1, ceil(count(*) / 16.0::DOUBLE))::BIGINT AS per_epoch FROM instr)""",
        "progress_eta": with_("eta")
        + f"""SELECT run_id, step, max_steps, {round_even('least(100.0::DOUBLE, 100.0::DOUBLE * step::DOUBLE / max_steps::DOUBLE)', 3)} AS pct,
              {round_even('elapsed', 3)} AS elapsed_s, {round_even('eta', 3)} AS eta_s FROM eta""",
        "duration_texts": with_("eta") + f"SELECT run_id, step, {duration('elapsed')} AS elapsed, {duration('eta')} AS eta FROM eta",
        "next_steps": with_("progress")
        + f"SELECT run_id, step, {following(10)} AS next_eval, {following(7)} AS next_save, NULL::BIGINT AS disabled FROM progress",
        "latest_checkpoint": with_("progress")
        + """SELECT run_id, arg_max('out/' || step || '/checkpoint-' || CASE WHEN k % 10 = 9 THEN 'tmp' ELSE (k * 10)::VARCHAR END,
              {'s': CASE WHEN k % 10 = 9 THEN 0 ELSE k * 10 END, 'q': step}) AS path FROM progress GROUP BY run_id""",
    }
)

ORACLES["stream_requests"] = ORACLES["request_metrics"]
ORACLES["stream_dedupe"] = with_("keyed") + "SELECT min(doc_id) AS doc_id, key, arg_min(lang, doc_id) AS lang FROM keyed GROUP BY key"
ORACLES["stream_aborts"] = (
    with_("streaks")
    + f"""SELECT model, level, s.a.m AS micros, s.a.i AS request_id FROM
        (SELECT model, level, min({{'m': micros, 'i': request_id}}) AS a FROM streaks WHERE streak >= {fv.FAILURE_LIMIT} GROUP BY ALL) s"""
)
DAY = 86_400_000_000
ORACLES["stream_summary"] = (
    with_("requests")
    + f"""SELECT micros // {DAY} * {DAY} AS window_start, level, count(*) AS requests_total, count(*) FILTER (WHERE success) AS requests_ok,
        {round_even("sum((CASE WHEN success THEN ttft END)::DECIMAL(18,9))::DOUBLE", 3)} AS ttft_sum,
        {round_even("sum((CASE WHEN success THEN total_time END)::DECIMAL(18,9))::DOUBLE", 3)} AS latency_sum,
        {round_even("max(total_time) FILTER (WHERE success)", 3)} AS latency_max, (sum(output_tokens) FILTER (WHERE success))::BIGINT AS tokens
      FROM requests GROUP BY ALL"""
)
ORACLES["stream_quantiles"] = (
    with_("requests")
    + f"""SELECT window_start, level, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2.0 AS total_time_median, v[least(n - 1, floor(n::DOUBLE * {fv.P95}::DOUBLE))::BIGINT + 1] AS total_time_p95
      FROM (SELECT micros // {DAY} * {DAY} AS window_start, level, list_sort(list(total_time)) AS v, count(*) AS n FROM requests WHERE success GROUP BY ALL)"""
)
ARRAY_ROWS = "SELECT doc_id >> 8 AS part, {pos} AS pos, doc_id, text AS prompt, source AS answer FROM documents"
ORACLES["scan_array"] = ARRAY_ROWS.format(pos="row_number() OVER (PARTITION BY doc_id >> 8 ORDER BY doc_id) - 1")
ORACLES["scan_mixed"] = ORACLES["scan_array"]
ORACLES["chunk_roundtrip"] = f"""
    SELECT CASE WHEN n <= {q.MANIFEST_CHUNK} THEN 'subset.jsonl' ELSE 'subset.part' || lpad((place // {q.MANIFEST_CHUNK} + 1)::VARCHAR, 3, '0') || '.jsonl' END AS source_file,
      place % {q.MANIFEST_CHUNK} AS pos, doc_id, text, source
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)"""
ORACLES["checkpoint_roundtrip"] = ORACLES["level_summary"]
ORACLES["results_roundtrip"] = f"SELECT *, 'benchmark_results_' || model AS file_name FROM ({ORACLES['level_summary']})"
ORACLES["length_groups"] = (
    with_("feat")
    + f""", kept AS (SELECT id, length, row_number() OVER (ORDER BY {seeded("id")}, id) - 1 AS place, count(*) OVER () AS n FROM feat WHERE length > prompt_len),
      runs AS (SELECT *, place // size AS run FROM (SELECT *, least(greatest(n // {4 * q.BATCH}, 1), {fv.MEGA_BATCHES}) * {q.BATCH} AS size FROM kept)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY length DESC, place) - 1 AS rank FROM runs),
      longest AS (SELECT run * size AS top FROM placed WHERE rank = 0 ORDER BY length DESC, run LIMIT 1),
      swapped AS (SELECT id, length, CASE WHEN run * size + rank = 0 THEN top WHEN run * size + rank = top THEN 0 ELSE run * size + rank END::BIGINT AS position FROM placed, longest)
      SELECT id, length, position, position // {q.BATCH} AS batch_id FROM swapped"""
)


def _lines(*parts: str) -> str:
    """SQL for lines of text, each an expression."""
    return " || chr(10) || ".join(parts)


QUOTED_LANG, QUOTED_SOURCE = "to_json(lang)::VARCHAR", "to_json(source)::VARCHAR"
ID_OBJECT = ["'{'", "'  \"id\": ' || doc_id || ','", "'  \"a\": ['", "'    1.5,'", "'    {},'", "'    [],'", "'    true'", "'  ],'", f"'  \"lang\": ' || {QUOTED_LANG}", "'}'"]
LIST = ["'['", "'  ' || n_chars || ','", "'  null,'", "'  \"x\"'", "']'"]
SAID_USER = ["'{'", f"'  \"t\": ' || {QUOTED_SOURCE} || ','", "'  \"b\": ['", "'    2,'", "'    1'", "'  ]'", "'}'"]
SAID_GPT = ["'['", "'  {'", "'    \"q\": \"é/\"'", "'  }'", "']'"]
NO_TOOL = ["'{'", "'  \"no\": 1'", "'}'"]


def _inside(first: str, parts: list[str], depth: int, last: str = "") -> list[str]:
    """The lines of a value inside another one: a key before the first, a comma behind the last."""
    pad = "  " * depth
    out = [f"'{pad}' || {p}" for p in parts]
    out[0] = f"'{pad}{first}' || {parts[0]}"
    out[-1] += f" || '{last}'"
    return out


RECORD = [
    "'{'", "'  \"z\": \"u\",'",
    *_inside('"prompt": ', ID_OBJECT, 1, ","),
    *_inside('"context": ', LIST, 1, ","),
    "'  \"answer\": 100.0,'", "'  \"messages\": ['",
    "'    {'", "'      \"role\": \"user\",'", *_inside('"content": ', SAID_USER, 3), "'    },'",
    "'    {'", "'      \"role\": \"gpt\",'", *_inside('"text": ', SAID_GPT, 3), "'    },'",
    "'    {'", "'      \"role\": \"user\",'", "'      \"content\": \"  said \"'", "'    },'",
    "'    {'", "'      \"from\": \"tool\",'", *_inside('"content": ', NO_TOOL, 3), "'    }'",
    "'  ]'", "'}'",
]
ORACLES["canonical_text_exact"] = f"SELECT doc_id, {_lines(*RECORD)} AS text FROM documents"
ORACLES["normalize_exact"] = f"SELECT doc_id, {_lines(*ID_OBJECT)} AS instruction, {_lines(*LIST)} AS input, '100.0' AS output, 'documents' AS source_file FROM documents"
ORACLES["chat_pair_objects"] = f"SELECT doc_id, {_lines(*SAID_USER)} || chr(10) || chr(10) || 'said' AS instruction, {_lines(*SAID_GPT)} AS output FROM documents"

ORACLES["resolve_sources"] = """
    WITH files AS (SELECT lang, doc_id % 3 AS shard, count(*) AS rows FROM documents GROUP BY ALL),
    train AS (SELECT *, CASE WHEN lang = 'de' THEN 0 ELSE 1 END AS entry FROM files WHERE lang = 'de' OR shard < 2)
    SELECT 'train' AS role, row_number() OVER (ORDER BY entry, lang, shard) - 1 AS place, lang, shard, rows FROM train
    UNION ALL SELECT 'validation', row_number() OVER (ORDER BY lang, shard) - 1, lang, shard, rows FROM files WHERE shard = 2"""
