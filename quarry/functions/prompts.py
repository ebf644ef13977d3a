"""Prompt and training-text formatting (SC-12, SC-13, SC-14, FLT-5, FLT-6) and chat rendering (SC-18).

Templates are data: one entry per template id, rendered with ``concat`` over trimmed, null-safe inputs,
so every row is formatted inside the JVM. The end-of-sequence token is the literal ``</s>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

EOS = "</s>"
BOS = "<s>"
RESPONSE_MARKER = T.RESPONSE_MARKER

# --- fixed values: prompt templates, with {schema} {question} {sql} {db_id} {instruction} {eos} slots ------
INSTRUCTION = "Database Schema:\n{schema}\n\nQuestion: {question}"
TEMPLATES = {
    # response-only training text (instruction slot = INSTRUCTION)
    "train_response_only": " ### Instruction: Generate a SQL query to answer the given question based on the "
                           "provided database schema\n{instruction}\n\n ### Response:\n{sql}{eos}",
    # full-sequence training text
    "train_complete": " ### Instruction:\nGenerate a SQL query to answer the given question based on the provided "
                      "database schema.\n\nDatabase Schema:\n{schema}\n\nQuestion: {question}\n\n ### Response:\n{sql}{eos}",
    # published dataset format
    "published": "### Task: Convert natural language question to SQL query\nDatabase: {db_id}\n"
                 "Database Schema: {schema}\n### Question: {question}\n### SQL: {sql}",
    # zero-shot inference
    "zero_shot": "### Task: Convert the following natural language question to a SQL query.  Give only SQL Query "
                 "as Output\n\n### Database Schema:\n{schema}\n\n### Question: {question}\n\n### SQL Query:\n",
    # self-correction first prompt
    "self_correction": "### Task: Convert the following natural language question to a SQL query. Give only SQL "
                       "Query as Output\n\n### Database Schema:\n{schema}\n\n### Question: {question}\n\n### SQL Query:\n",
    # judge prompt
    "judge": "-- Database Schema\n{schema}\n\n-- Question: {question}\n-- SQL Query: {sql}\n\nDoes this SQL query "
             "correctly answer the question? Answer with 'Yes' or 'No' followed by a brief explanation.\nAnswer:",
    # fine-tuned inference (its body is indented by four spaces)
    "sft_inference": " ### Instruction: Generate a SQL query to answer the given question based on the provided "
                     "database schema\n    {instruction}\n    \n     ### Response:\n    ",
    # prompt-optimizer evaluation and training prompts
    "optimizer_eval": "Schema:\n{schema}\n\nQuestion: {question}\nSQL:",
    "optimizer_train": "Schema:\n{schema}\nQuestion: {question}",
}
# Templates whose inputs are trimmed first (the training formatters strip their fields).
TRIMMED = {"train_response_only", "train_complete"}

FEW_SHOT_HEAD = "### Task: Convert natural language questions to SQL queries.  Give only SQL Query as Output \n\n" \
                "### Examples:\n\n"
FEW_SHOT_EXAMPLE = "**Example {i}:**\nSchema: {context}\nQuestion: {question}\nSQL: {sql}\n\n"
FEW_SHOT_TAIL = "### Now convert this question:\nSchema:\n{schema}\n\nQuestion: {question}\n\nSQL Query:\n"


def _fill(template: str, slots: dict[str, Column]) -> Column:
    """Render ``template`` by splitting on its ``{slot}`` markers and concatenating literals and columns."""
    import re
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def render(template_id: str, schema="context", question="question", sql="sql", db_id="db_id") -> Column:
    """SC-12: render one template. Missing fields become ''; training templates trim their inputs."""
    def val(c):
        col = (F.col(c) if isinstance(c, str) else c)
        col = F.coalesce(col, F.lit(""))
        return T.py_strip(col) if template_id in TRIMMED else col
    slots = {"schema": val(schema), "question": val(question), "sql": val(sql), "db_id": val(db_id),
             "eos": F.lit(EOS)}
    slots["instruction"] = _fill(INSTRUCTION, slots)
    return _fill(TEMPLATES[template_id], slots)


def few_shot_prompt(shots: Column, schema="context", question="question") -> Column:
    """SC-12 few-shot: header, up to two examples (array<struct<context,question,sql>>), then the question."""
    def ex_block(x, i):
        return F.concat(F.lit("**Example "), (i + 1).cast("string"), F.lit(":**\nSchema: "),
                        F.coalesce(x["context"], F.lit("N/A")), F.lit("\nQuestion: "), x["question"],
                        F.lit("\nSQL: "), F.coalesce(x["sql"], F.lit("")), F.lit("\n\n"))
    body = F.array_join(F.transform(F.slice(shots, 1, 2), ex_block), "")
    tail = _fill(FEW_SHOT_TAIL, {"schema": F.col(schema) if isinstance(schema, str) else schema,
                                 "question": F.col(question) if isinstance(question, str) else question})
    return F.concat(F.lit(FEW_SHOT_HEAD), body, tail)


def response_mask(text="text") -> list[Column]:
    """SC-13: locate ``### Response:``; prompt part, response part and a has-marker flag (character level)."""
    t = F.col(text) if isinstance(text, str) else text
    pos = F.instr(t, RESPONSE_MARKER)
    return [
        (pos > 0).alias("has_response_marker"),
        F.when(pos > 0, F.substring(t, 1, 1 << 30).substr(F.lit(1), pos - 1)).alias("prompt_part"),
        F.when(pos > 0, F.substring(t, 1, 1 << 30).substr(pos + F.lit(len(RESPONSE_MARKER)), F.lit(1 << 30)))
         .alias("response_part"),
    ]


def keep_long_texts(df: DataFrame, text: str = "text", min_chars: int = 10) -> DataFrame:
    """FLT-5: keep formatted texts longer than ``min_chars`` characters."""
    return df.filter(F.length(text) > min_chars)


def long_text_counts(df: DataFrame, text: str = "text", min_chars: int = 10) -> DataFrame:
    """FLT-5's accounts in one row: formatted texts, those kept and those dropped (a null text is dropped)."""
    n, kept = F.count(F.lit(1)), F.count_if(F.length(text) > min_chars)
    return df.agg(n.alias("formatted"), kept.alias("kept"), (n - kept).alias("dropped"))


def usable_schema(df: DataFrame, schema: str = "schema") -> DataFrame:
    """FLT-6: drop evaluation rows whose schema is empty or only a ``Database:`` placeholder."""
    return df.filter((F.coalesce(F.col(schema), F.lit("")) != "") & ~F.col(schema).startswith("Database:"))


# --- SC-18: chat rendering ------------------------------------------------------------------------------

def render_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 content: str = "text") -> DataFrame:
    """SC-18 (T12): one training string per conversation.

    A leading system message is removed and folded into the first remaining message as
    ``<<SYS>>\\n…\\n<</SYS>>\\n\\n``; users must sit on even positions and others on odd ones (else
    ``is_valid`` false); user -> ``<s>[INST] trimmed [/INST]``, assistant -> `` trimmed </s>``; any other
    role on an odd position is dropped. One ordered aggregate per conversation (a chat is one group).
    """
    g = messages.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"),
                                                                         F.col(role).alias("r"),
                                                                         F.col(content).alias("c")))).alias("m"))
    first_is_sys = F.element_at(F.col("m"), 1)["r"] == "system"
    sys_text = F.when(first_is_sys, F.element_at(F.col("m"), 1)["c"])
    loop = F.when(first_is_sys, F.slice(F.col("m"), 2, 1 << 30)).otherwise(F.col("m"))
    g = g.select(conv, sys_text.alias("sys"), loop.alias("loop"))

    def piece(x, i):
        c = F.when((i == 0) & F.col("sys").isNotNull(),
                   F.concat(F.lit("<<SYS>>\n"), F.col("sys"), F.lit("\n<</SYS>>\n\n"), x["c"])).otherwise(x["c"])
        c = T.py_strip(c)
        return (F.when(x["r"] == "user", F.concat(F.lit(BOS + "[INST] "), c, F.lit(" [/INST]")))
                .when(x["r"] == "assistant", F.concat(F.lit(" "), c, F.lit(" " + EOS)))
                .otherwise(F.lit("")))

    valid = F.forall(F.transform("loop", lambda x, i: (x["r"] == "user") == (i % 2 == 0)), lambda b: b)
    return g.select(conv, F.array_join(F.transform("loop", piece), "").alias("text"),
                    valid.alias("is_valid"), F.size("loop").alias("n_messages"))
