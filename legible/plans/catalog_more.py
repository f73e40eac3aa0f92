"""Queries beyond the first slice: units, packing, prompts, replies (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import infer as I
from legible.operators.extract import behavior_signals, line_units, unit_counts
from legible.operators.order import fixed_slices
from legible.operators.pack import pack_by_budget
from legible.plans.catalog import docs, register
from legible.sources.tables import table

# ============================================================ units

SQL_LINES = r"""
WITH u AS (
  SELECT doc_id, source, i - 1 AS line_no, l[i] AS line FROM (
    SELECT doc_id, source, l, unnest(generate_series(1, len(l))) AS i
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
  WHERE l[i] <> ''),
w AS (SELECT *, regexp_extract_all(line, '[A-Za-z]+') AS words FROM u),
units AS (
  SELECT doc_id, line_no::BIGINT AS line_no, source, line, lower(coalesce(words[1], '')) AS method_name,
         words[2:3] AS params FROM w)"""


@register("line_units", SQL_LINES + """
SELECT doc_id, line_no, method_name, len(params)::BIGINT AS n_params,
       CASE WHEN method_name = '' THEN 'class' ELSE 'method' END AS unit_kind FROM units""")
def q_line_units(spark, d):
    u = line_units(docs(spark, d, "doc_id", "text", "source"))
    return u.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "method_name",
                    F.size("param_types").cast("bigint").alias("n_params"), "unit_kind")


@register("unit_counts", SQL_LINES + """
SELECT CASE WHEN method_name = '' THEN 'class' ELSE 'method' END AS unit_kind, count(*)::BIGINT AS n_units
FROM units GROUP BY 1""")
def q_unit_counts(spark, d):
    return unit_counts(line_units(docs(spark, d, "doc_id", "text", "source")))


@register("qualified_signature", SQL_LINES + """
SELECT doc_id, line_no,
       CASE WHEN method_name = '' THEN source || '.Doc' || doc_id
            ELSE source || '.Doc' || doc_id || '.' || method_name || '(' || array_to_string(params, ',') || ')' END
         AS qualified_signature FROM units""")
def q_qualified_signature(spark, d):
    u = line_units(docs(spark, d, "doc_id", "text", "source"))
    return u.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "qualified_signature")


#: The lexical mask in DuckDB's syntax: comments, text blocks, strings and chars, left to right.
SQL_LEXEME = (r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|" + '"{3}' + r'(?s:(?:[^"\\]|\\.|"[^"]|""[^"])*)"{3}|"(?:[^"\\\n]|\\[^\n])*"|'
              + r"''(?:[^''\\\n]|\\[^\n])*''")


@register("string_literals", r'''
SELECT page_id, len(lits)::BIGINT AS n_literals, array_to_string(lits, chr(31)) AS literals FROM (
  SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS lits
  FROM (SELECT page_id, list_transform(list_filter(regexp_extract_all(html, '{lex}'),
               lambda x: starts_with(x, chr(34)) AND NOT starts_with(x, repeat(chr(34), 3))), lambda x: substr(x, 2, length(x) - 2)) AS l
        FROM pages))'''.replace("{lex}", SQL_LEXEME))
def q_string_literals(spark, d):
    lits = T.string_literals(F.col("html"))
    return table(spark, d, "pages", "page_id", "html").select(
        "page_id", F.size(lits).cast("bigint").alias("n_literals"), F.array_join(lits, "\x1f").alias("literals"))


@register("behavior_signals", r"""
SELECT doc_id,
  len(list_filter(toks, lambda t: t IN ('for', 'while')))::BIGINT AS loops,
  len(list_filter(toks, lambda t: t IN ('if', 'switch')))::BIGINT AS conditionals
FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '%s', ' ', 'g'), '[^A-Za-z0-9_$]') AS toks FROM documents)""" % SQL_LEXEME)
def q_behavior_signals(spark, d):
    s = behavior_signals(F.col("text"))
    return docs(spark, d, "doc_id", "text").select(
        "doc_id", s["loops"].cast("bigint").alias("loops"), s["conditionals"].cast("bigint").alias("conditionals"))


# ============================================================ packing

PACK_BUDGET, PACK_MAX = 200, 3

SQL_PACK = """
WITH RECURSIVE items AS (
  SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS seq,
         greatest(1, ceil(length(coalesce(text, '')) / 3.5))::BIGINT AS tok FROM conversations),
walk(conv_id, seq, batch_no, pos, cur_tok, cur_n) AS (
  SELECT conv_id, seq, 0::BIGINT, 0::BIGINT, tok, 1 FROM items WHERE seq = 0
  UNION ALL
  SELECT i.conv_id, i.seq,
    CASE WHEN w.cur_tok + i.tok > %(b)d OR w.cur_n >= %(m)d THEN w.batch_no + 1 ELSE w.batch_no END,
    CASE WHEN w.cur_tok + i.tok > %(b)d OR w.cur_n >= %(m)d THEN 0 ELSE w.pos + 1 END,
    CASE WHEN w.cur_tok + i.tok > %(b)d OR w.cur_n >= %(m)d THEN i.tok ELSE w.cur_tok + i.tok END,
    CASE WHEN w.cur_tok + i.tok > %(b)d OR w.cur_n >= %(m)d THEN 1 ELSE w.cur_n + 1 END
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.seq = w.seq + 1),
packed AS (
  SELECT i.conv_id, i.turn, i.text, i.tok AS tokens, w.batch_no, w.pos
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.seq = w.seq)""" % {"b": PACK_BUDGET, "m": PACK_MAX}


def _packed(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return pack_by_budget(conv, ["conv_id"], ["turn"], text_col="text", budget=PACK_BUDGET, max_items=PACK_MAX)


@register("pack_by_budget", SQL_PACK + " SELECT conv_id, turn, tokens, batch_no, pos FROM packed")
def q_pack_by_budget(spark, d):
    return _packed(spark, d).select("conv_id", "turn", "tokens", "batch_no", "pos")


@register("fixed_slices", """
SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 12)::BIGINT AS slice_no,
       length(text)::BIGINT AS n_text
FROM documents""")
def q_fixed_slices(spark, d):
    # the text travels along as payload
    return fixed_slices(docs(spark, d, "doc_id", "lang", "text"), ["lang"], ["doc_id"], 12).select(
        "doc_id", "lang", "slice_no", F.length("text").cast("bigint").alias("n_text"))


# ============================================================ prompts

def conversation_units(conv):
    """Turns as units: package ``chat.<role>``, class ``Conv<id>``, method ``turn<n>(role)``."""
    u = (conv.withColumn("pkg", F.concat(F.lit("chat."), F.col("role")))
             .withColumn("class_name", F.concat(F.lit("Conv"), F.col("conv_id").cast("string")))
             .withColumn("method_name", F.concat(F.lit("turn"), F.col("turn").cast("string")))
             .withColumn("param_types", F.array(F.col("role")))
             .withColumn("strings", T.string_literals(F.col("text")))
             .withColumn("code", F.col("text")))
    return (u.withColumn("class_fqn", T.class_fqn("pkg", "class_name"))
             .withColumn("qualified_signature",
                         T.qualified_signature("pkg", "class_name", "method_name", "param_types")))


SQL_BLOCK_T = r"""
'// META' || chr(10) || 'packageName: chat.' || {role} || chr(10) || 'className: Conv' || {conv_id} || chr(10) ||
'classFqn: chat.' || {role} || '.Conv' || {conv_id} || chr(10) || 'methodName: turn' || {turn} || chr(10) ||
'methodSignature: chat.' || {role} || '.Conv' || {conv_id} || '.turn' || {turn} || '(' || {role} || ')' || chr(10) ||
'paramTypes: ' || {role} || chr(10) || chr(10) || '```java' || chr(10) ||
CASE WHEN len(string_split({text}, chr(10))) <= 105 THEN {text} ELSE
  array_to_string(list_transform(string_split({text}, chr(10))[1:50], lambda x: x || chr(10)), '') ||
  '// ... (trimmed) ...' || chr(10) ||
  array_to_string(list_transform(string_split({text}, chr(10))[-50:], lambda x: x || chr(10)), '') END ||
chr(10) || '```' || chr(10)"""
SQL_BLOCK = SQL_BLOCK_T.format(role="role", conv_id="conv_id", turn="turn", text="text")


@register("prompt_blocks", "SELECT conv_id, turn, %s AS block FROM conversations" % SQL_BLOCK)
def q_prompt_blocks(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return I.prompt_block(conversation_units(conv)).select("conv_id", "turn", "block")


SQL_PROMPTS = SQL_PACK + """,
prompts AS (
  SELECT conv_id, batch_no, count(*)::BIGINT AS n_items,
         %s || string_agg('### ITEM ' || (pos + 1) || chr(10) || block, chr(10) ORDER BY pos) AS prompt
  FROM (SELECT p.conv_id, p.batch_no, p.pos, %s AS block FROM packed p JOIN conversations c USING (conv_id, turn))
  GROUP BY conv_id, batch_no)""" % ("'" + I.RENAME_RULES.replace("'", "''") + "' || chr(10) || chr(10)",
                                    SQL_BLOCK_T.format(role="c.role", conv_id="p.conv_id", turn="p.turn", text="c.text"))


def _prompts(spark, d):
    packed = _packed(spark, d)
    blocks = I.prompt_block(conversation_units(packed))
    return I.batch_prompts(blocks, ["conv_id", "batch_no"])


@register("rename_prompts", SQL_PROMPTS + " SELECT conv_id, batch_no, n_items, prompt FROM prompts")
def q_rename_prompts(spark, d):
    return _prompts(spark, d)


@register("json_request", SQL_PROMPTS + """
SELECT conv_id, batch_no, 'offline-model' AS model, '4096' AS max_tokens, '0.2' AS temperature,
       '2' AS n_messages, prompt AS user_content FROM prompts""")
def q_json_request(spark, d):
    req = I.with_request(_prompts(spark, d), "offline-model")
    r = F.col("request")
    return req.select("conv_id", "batch_no",
                      F.get_json_object(r, "$.model").alias("model"),
                      F.get_json_object(r, "$.max_tokens").alias("max_tokens"),
                      F.get_json_object(r, "$.temperature").alias("temperature"),
                      F.json_array_length(F.get_json_object(r, "$.messages")).cast("string").alias("n_messages"),
                      F.get_json_object(r, "$.messages[1].content").alias("user_content"))


SQL_ECHO_ITEMS = SQL_PROMPTS + """,
echo_items AS (SELECT conv_id, batch_no,
                 '[' || string_agg('{"kind": "method", "old": "turn' || turn || '", "new": "handleTurn' || turn || '"}',
                                   ', ' ORDER BY pos) || ']' AS js
          FROM packed GROUP BY conv_id, batch_no)"""


@register("batch_infer", SQL_ECHO_ITEMS + """
SELECT p.conv_id, p.batch_no,
       CASE length(p.prompt) % 3 WHEN 0 THEN i.js WHEN 1 THEN '{"renames": ' || i.js || '}'
            ELSE 'Here you go:' || chr(10) || '```json' || chr(10) || i.js || chr(10) || '```' END AS reply,
       NULL::VARCHAR AS error, 1 AS attempts
FROM prompts p JOIN echo_items i USING (conv_id, batch_no)""")
def q_batch_infer(spark, d):
    """I5 with the offline provider: one reply per prompt batch (rows-only check)."""
    prompts = _prompts(spark, d)
    res = I.batch_infer(prompts, I.EchoRenameProvider(), ["conv_id", "batch_no"], concurrency=8)
    return res.select("conv_id", "batch_no", "reply", "error", "attempts")


@register("provider_suggestions", SQL_PACK + """
SELECT conv_id, batch_no, pos::BIGINT AS pos, 'method' AS kind, 'turn' || turn AS old, 'handleTurn' || turn AS new
FROM packed""")
def q_provider_suggestions(spark, d):
    """I5 -> I7: offline replies parsed into suggestion rows (rows-only check)."""
    prompts = _prompts(spark, d)
    res = I.batch_infer(prompts, I.EchoRenameProvider(), ["conv_id", "batch_no"], concurrency=8)
    return I.parse_suggestions(res, ["conv_id", "batch_no"])


# ============================================================ replies
# Reply bodies are assembled from labelled documents in six transport shapes and four content
# shapes, so both engines parse exactly the same strings.

def _reply_frame(spark, d):
    lab = table(spark, d, "labels", "doc_id")
    ds = docs(spark, d, "doc_id", "text").join(lab, "doc_id", "left_semi")
    # the first three ASCII words in one regex match (not a list of every word of the text)
    three = "(?s)^[^A-Za-z]*([A-Za-z]+)(?:[^A-Za-z]+([A-Za-z]+))?(?:[^A-Za-z]+([A-Za-z]+))?"
    w1, w2, w3 = (F.when(F.regexp_extract("text", three, i) == "", F.lit("x"))
                  .otherwise(F.regexp_extract("text", three, i)) for i in (1, 2, 3))
    q = F.lit('"')
    arr0 = F.concat(F.lit('[{"kind":"var","old":'), q, w1, q, F.lit(',"new":'), q, w2, q,
                    F.lit('},{"type":"method","from":'), q, w2, q, F.lit(',"to":'), q, w3, q, F.lit("}]"))
    c1 = F.concat(F.lit('{"renames":[{"kind":"class","key":'), q, w1, q, F.lit(',"value":'), q, w3, q, F.lit("}]}"))
    c2 = F.concat(F.lit("Here:\n```json\n"), arr0, F.lit("\n```"))
    c3 = F.concat(F.lit('{"items":[{"kind":"field","name":'), q, w1, q, F.lit(',"rename":'), q, w2, q,
                  F.lit(',"reason":"x"},{"kind":"var","old":'), q, w3, q, F.lit("}]}"))
    cv = (F.col("doc_id") / 6).cast("bigint") % 4
    content = F.when(cv == 0, arr0).when(cv == 1, c1).when(cv == 2, c2).otherwise(c3)
    msg = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    esc = F.replace(F.replace(F.replace(content, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit("\n"), F.lit("\\n"))
    tv = F.col("doc_id") % 6
    body = (F.when(tv == 0, F.to_json(F.struct(F.array(F.struct(msg.alias("message"))).alias("choices"))))
             .when(tv == 1, F.to_json(F.struct(msg.alias("message"))))
             .when(tv == 2, F.to_json(F.struct(content.alias("response"))))
             .when(tv == 3, F.to_json(F.struct(F.array(F.struct(content.alias("text"))).alias("choices"))))
             .when(tv == 4, F.concat(F.lit('{"choices":[{"message":{"content":"'), esc, F.lit('"}}')))
             .otherwise(content))
    return ds.select("doc_id", body.alias("reply"))


SQL_REPLIES = r"""
WITH ds AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM ds),
c AS (SELECT doc_id, coalesce(ws[1], 'x') AS w1, coalesce(ws[2], 'x') AS w2, coalesce(ws[3], 'x') AS w3 FROM w),
a AS (SELECT doc_id, w1, w2, w3,
        '[{"kind":"var","old":"' || w1 || '","new":"' || w2 || '"},{"type":"method","from":"' || w2 ||
        '","to":"' || w3 || '"}]' AS arr0 FROM c),
cc AS (SELECT doc_id, CASE (doc_id // 6) % 4
          WHEN 0 THEN arr0
          WHEN 1 THEN '{"renames":[{"kind":"class","key":"' || w1 || '","value":"' || w3 || '"}]}'
          WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || arr0 || chr(10) || '```'
          ELSE '{"items":[{"kind":"field","name":"' || w1 || '","rename":"' || w2 ||
               '","reason":"x"},{"kind":"var","old":"' || w3 || '"}]}' END AS content FROM a),
replies AS (SELECT doc_id, CASE doc_id % 6
          WHEN 0 THEN to_json({'choices': [{'message': {'role': 'assistant', 'content': content}}]})::VARCHAR
          WHEN 1 THEN to_json({'message': {'role': 'assistant', 'content': content}})::VARCHAR
          WHEN 2 THEN to_json({'response': content})::VARCHAR
          WHEN 3 THEN to_json({'choices': [{'text': content}]})::VARCHAR
          WHEN 4 THEN '{"choices":[{"message":{"content":"' ||
                      replace(replace(replace(content, '\', '\\'), '"', '\"'), chr(10), '\n') || '"}}'
          ELSE content END AS reply FROM cc),
chat AS (SELECT doc_id, reply, CASE WHEN json_valid(reply) THEN coalesce(
            json_extract_string(reply, '$.choices[0].message.content'),
            json_extract_string(reply, '$.message.content'),
            json_extract_string(reply, '$.response'),
            json_extract_string(reply, '$.choices[0].text'), reply)
          WHEN strpos(reply, '"content":"') > 0 THEN
            array_to_string(list_transform(
              regexp_extract_all(regexp_extract(reply, '(?s).*"content":"((?:[^"\\]|\\.)*)', 1), '\\.|[^\\]+'),
              lambda t: CASE WHEN t = '\n' THEN chr(10) WHEN t = '\t' THEN chr(9)
                             WHEN starts_with(t, '\') THEN substr(t, 2, 1) ELSE t END), '')
          ELSE reply END AS content FROM replies),
fence AS (SELECT doc_id, content, strpos(content, '```') AS f1 FROM chat),
fence2 AS (SELECT doc_id, content, f1, CASE WHEN f1 > 0 THEN strpos(substr(content, f1 + 3), '```') ELSE 0 END AS f2
           FROM fence),
cleaned AS (SELECT doc_id, regexp_replace(CASE WHEN f1 > 0 AND f2 > 0 THEN substr(content, f1 + 3, f2 - 1)
                                              ELSE content END, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS cl
            FROM fence2),
payload AS (SELECT doc_id, CASE
            WHEN strpos(cl, '[') > 0 AND (strpos(cl, '{') = 0 OR strpos(cl, '[') < strpos(cl, '{'))
              THEN substr(cl, strpos(cl, '['))
            WHEN strpos(cl, '{') > 0 THEN substr(cl, strpos(cl, '{')) END AS payload FROM cleaned)"""


@register("extract_chat_content", SQL_REPLIES + " SELECT doc_id, content FROM chat")
def q_extract_chat_content(spark, d):
    return _reply_frame(spark, d).select("doc_id", T.extract_chat_content(F.col("reply")).alias("content"))


@register("extract_json_payload", SQL_REPLIES + " SELECT doc_id, payload FROM payload")
def q_extract_json_payload(spark, d):
    r = _reply_frame(spark, d)
    return r.select("doc_id", T.extract_json_payload(T.extract_chat_content(F.col("reply"))).alias("payload"))


SQL_PARSED = SQL_REPLIES + r""",
arr AS (SELECT doc_id, CASE WHEN starts_with(payload, '[') THEN json_extract(payload, '$[*]')
          WHEN json_extract(payload, '$.renames') IS NOT NULL AND json_type(json_extract(payload, '$.renames')) <> 'NULL'
            THEN json_extract(payload, '$.renames[*]')
          ELSE json_extract(payload, '$.items[*]') END AS items
        FROM payload),
flat AS (SELECT doc_id, i - 1 AS pos, items[i] AS it FROM (
          SELECT doc_id, items, unnest(generate_series(1, len(items))) AS i FROM arr WHERE len(items) > 0)),
parsed AS (SELECT doc_id, pos::BIGINT AS pos,
     coalesce(json_extract_string(it, '$.kind'), json_extract_string(it, '$.type')) AS kind,
     coalesce(json_extract_string(it, '$.old'), json_extract_string(it, '$.from'),
              json_extract_string(it, '$.key'), json_extract_string(it, '$.name')) AS old,
     coalesce(json_extract_string(it, '$.new'), json_extract_string(it, '$.to'),
              json_extract_string(it, '$.value'), json_extract_string(it, '$.rename')) AS new
   FROM flat)"""


@register("parse_suggestions", SQL_PARSED + """
SELECT doc_id, pos, kind, old, new FROM parsed WHERE kind IS NOT NULL AND old IS NOT NULL AND new IS NOT NULL""")
def q_parse_suggestions(spark, d):
    return I.parse_suggestions(_reply_frame(spark, d), ["doc_id"])


from legible.plans import catalog_mapping  # noqa: E402,F401  (registers mapping/doc/folder queries)
