"""Derived input tables, one SQL template each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.catalog.dialect import Duck, Spark

SUFFIXES = ["txt", "md", "log", "yaml", "py", "pdf", "csv", "bin"]
NL = "chr(10)"


def _pick(x: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {x} % {len(values)} {cases} ELSE '{values[-1]}' END"


def documents(d) -> str:
    return f"SELECT doc_id, text, lang, source FROM {d.table('documents')}"


def dirty(d) -> str:
    """Texts with mixed line ends, tabs, no-break spaces, control characters, trailing blanks and long gaps."""
    x = "replace(text, ', ', ',' || chr(9))"
    x = f"replace({x}, '. ', '.  ' || chr(13) || chr(10))"
    x = f"replace({x}, ' e', chr(160) || 'e')"
    x = f"replace({x}, ' un', chr(11) || 'un')"
    x = f"replace({x}, ' a', chr(1) || 'a')"
    gaps = f"{NL} || {NL} || '  ' || {NL} || {NL} || {NL} || {NL}"
    return (
        f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace({x}, {NL}, {gaps}) ELSE '  ' || {x} || ' ' || chr(9) END "
        f"AS text FROM {d.table('documents')}"
    )


def sentences(d) -> str:
    """(doc_id, parts): the non-empty sentences of each document."""
    parts = d.filter(d.split("text", f"'[.' || {NL} || ']+ *'"), lambda v: f"{v} <> ''")
    return f"SELECT doc_id, lang, source, {parts} AS parts FROM {d.table('documents')}"


def shaped(d) -> str:
    """Structured documents: sentence n of a document, whole, gets one of sixteen line shapes in turn."""
    def body(v: str, i: str) -> str:
        n = d.text(f"{d.div(i, '16')} + 1")
        forms = [
            f"{n} || '. Part ' || {n} || {NL} || {v}",
            v,
            v,
            f"'- ' || {v}",
            f"'* ' || {v}",
            f"{NL} || {v}",
            f"'Run step ' || {n} || ':' || {NL} || {v}",
            f"'    key = ' || {v}",
            f"'```bash' || {NL} || {v} || {NL} || {NL} || '# x' || {NL} || '```'",
            v,
            f"'Part ' || {n} || ' ..... ' || {d.text(i)} || {NL} || {v}",
            f"{n} || '.' || {NL} || 'Title of part ' || {n} || {NL} || {v}",
            f"'Note: ' || {v}",
            f"'Contents' || {NL} || {v}",
            f"{v} || '   '",
            f"{NL} || {NL} || 'Warning ' || {v}",
        ]
        cases = " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms[:-1]))
        return f"CASE (doc_id * 3 + {i}) % 16 {cases} ELSE {forms[-1]} END"

    text = d.join(d.transform("parts", body), NL)
    return f"SELECT doc_id, lang, source, {text} AS text FROM ({sentences(d)}) AS s WHERE {_len(d, 'parts')} > 0"


def _len(d, items: str) -> str:
    return f"size({items})" if isinstance(d, Spark) else f"len({items})"


def paged(d) -> str:
    """Documents with form feeds every four sentences, a running header and footer and some near-empty pages."""
    def body(v: str, i: str) -> str:
        edge = f"'Page head ' || lang || {NL}"
        foot = f"{NL} || 'footer ' || source"
        return (
            f"CASE WHEN {i} % 4 = 0 THEN {edge} || {v} WHEN {i} % 4 = 3 AND doc_id % 5 = 0 THEN {v} || {foot} || chr(12) || '  ' || chr(12) "
            f"WHEN {i} % 4 = 3 THEN {v} || {foot} || chr(12) ELSE {v} END"
        )

    text = d.join(d.transform("parts", body), NL)
    return f"SELECT doc_id, {text} AS text FROM ({sentences(d)}) AS s WHERE {_len(d, 'parts')} > 0"


def files(d) -> str:
    """Documents as files below collection folders."""
    name = f"'doc_' || {d.text('doc_id')} || '.' || {_pick('doc_id', SUFFIXES)}"
    return (
        f"SELECT doc_id, name AS file_name, 'kb/' || lang || '/' || source || '/' || name AS path, "
        f"lang || '/' || source || '/' || name AS relative_path, lang, source, text, "
        f"length(text) * (CASE WHEN doc_id % 50 = 0 THEN 4000 ELSE 1 END) AS size_bytes, "
        f"1700000000000 + doc_id * 1000 AS modified_ms "
        f"FROM (SELECT *, {name} AS name FROM {d.table('documents')}) AS t"
    )


def line_chunks(d) -> str:
    """Every document line as a chunk; a file holds the lines of one document."""
    lines = d.unnest(f"({files(d)}) AS f", d.split("text", NL), "doc_id, path, file_name, lang")
    kind = "CASE lang WHEN 'en' THEN 'procedure' WHEN 'fr' THEN 'reference' WHEN 'de' THEN 'scenario' ELSE 'config' END"
    return (
        f"SELECT path, file_name, CASE WHEN lang = 'es' THEN 'config' ELSE 'doc' END AS source_type, {kind} AS source_role, "
        f"pos AS chunk_index, item AS text, doc_id FROM ({lines}) AS l WHERE item <> ''"
    )


def doc_chunks(d) -> str:
    """Every document as a chunk of its source file, so sources hold many chunks."""
    kind = "CASE lang WHEN 'en' THEN 'procedure' WHEN 'fr' THEN 'reference' WHEN 'de' THEN 'scenario' ELSE 'config' END"
    return (
        f"SELECT 'kb/' || source || '.txt' AS path, source || '.txt' AS file_name, 'doc' AS source_type, "
        f"{kind} AS source_role, doc_id AS chunk_index, text FROM {d.table('documents')}"
    )


def queries(d) -> str:
    """Benchmark passages, whole, as search queries."""
    intents = ["general", "troubleshooting", "document_generation", "architecture", "implementation"]
    return f"SELECT item_id AS query_id, text AS query, {_pick('item_id', intents)} AS intent FROM {d.table('benchmark')}"


def prompts(d) -> str:
    """Conversation messages as prompts: a marker phrase in front, in turn, so every rule is met."""
    phrases = [
        "", "Please extract all commands and yaml snippets from ", "Summarize the document about ",
        "Write a MOP for the cluster vpn 24.09 deploying ", "Create a runbook for controllers and workers ",
        "What is the latest version of ", "In this repo the function failed with error ", "Show the topology architecture hld ",
        "How to deploy and install bootstrap ", "Search the web for ", "Remember that release 24.5 ",
        "From now on ", "I prefer short answers ", "See 10.1.2.3 and mail a.user@example.org or https://x.example.com/p ",
        "Write a guide on design of ", "token 0123456789abcdef0123 and ABCDEFGHIJKLMNOPQRSTUVWX_1 ",
    ]
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(phrases[:-1]))
    lead = f"CASE (conv_id * 5 + turn) % {len(phrases)} {cases} ELSE '{phrases[-1]}' END"
    return (
        f"SELECT conv_id * 1000 + turn AS prompt_id, conv_id, turn, role, {lead} || text AS prompt "
        f"FROM {d.table('conversations')}"
    )


def transform_prompts(d) -> str:
    """Prompts with pasted source material: an instruction block, a blank line, an assistant text."""
    return (
        f"SELECT conv_id * 1000 + turn AS prompt_id, CASE WHEN turn % 3 = 0 THEN 'Rewrite the following ' WHEN turn % 3 = 1 "
        f"THEN 'Look at this ' ELSE 'hello ' END || text || {NL} || '  ' || {NL} || text AS prompt "
        f"FROM {d.table('conversations')}"
    )


def marked_messages(d) -> str:
    """Messages with question marks and refusals in turn, and fenced code in some."""
    user = "CASE WHEN (conv_id + turn) % 4 = 0 THEN text || '?' ELSE text END"
    refusal = "'I don''t know based on the provided context. ' || text"
    code = f"text || {NL} || '```python' || {NL} || 'x = 1' || {NL} || text || {NL} || '```' || {NL} || 'tail' "
    open_code = f"{code} || {NL} || 'more ``` sql ' || {NL} || 'select 1'"
    stamp = f"'2024-01-01T00:00:' || right('0' || {d.text('turn')}, 2) || '.' || right('000000' || {d.text('conv_id')}, 6)"
    return (
        f"SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {user} WHEN role = 'assistant' AND conv_id % 3 = 0 "
        f"THEN {refusal} WHEN role = 'assistant' AND conv_id % 3 = 1 THEN {code} WHEN role = 'assistant' THEN {open_code} "
        f"ELSE text END AS text, {stamp} AS created_at FROM {d.table('conversations')}"
    )


def memories(d) -> str:
    """User messages as memories: some unsafe values, keys that repeat."""
    key, value = f"'note-' || {d.text('conv_id % 50')} || '-' || {d.text('turn')}", "text"
    return (
        f"SELECT 'm' || {d.text('conv_id')} || '_' || {d.text('turn')} AS id, lower({key}) AS key, "
        f"CASE WHEN conv_id % 7 = 0 THEN {value} || ' assistant' WHEN conv_id % 11 = 0 THEN {value} || '?' ELSE {value} END AS value, "
        f"{_pick('conv_id', ['general', 'preference', 'environment'])} AS category, '2024-01-0' || {d.text('turn + 1')} AS created_at, "
        f"'2024-02-0' || {d.text('turn + 1')} AS updated_at, CASE conv_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.5 END AS confidence, "
        f"conv_id % 13 = 0 AS pinned, conv_id * 100 + turn AS seq FROM {d.table('conversations')} WHERE role = 'user'"
    )


def manifest(d) -> str:
    """One manifest entry per document with an even source number; the others are legacy files."""
    return (
        f"SELECT lang AS collection_id, 'Label ' || lang AS collection_label, '2024-01-01T00:00:00Z' AS created_at, "
        f"path AS internal_path, source || '/' || file_name AS relative_path, '/orig/' || path AS original_path, "
        f"'g-' || lang || '-' || source AS group_id, source AS group_label, doc_id AS ord "
        f"FROM ({files(d)}) AS f WHERE lang <> 'es'"
    )


def looped(d) -> str:
    """Messages in which one line repeats: conversation number modulo nine times, then another line."""
    line = f"replace(text, {NL}, ' ')"
    return (
        f"SELECT conv_id, turn, text || {NL} || repeat({line} || '!' || {NL}, CAST(conv_id % 9 AS INT)) || 'end of text' || {NL} "
        f"AS text FROM {d.table('conversations')}"
    )


def tagged(d) -> str:
    """Messages with hidden spans inside."""
    return (
        f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '<think> ' || text || ' </think>' || text "
        f"WHEN turn % 3 = 1 THEN '<hidden_thinking>' || text || '</hidden_thinking>' || text || '<END>' "
        f"ELSE text || '<think>' || text END AS text FROM {d.table('conversations')}"
    )


def frame(spark: SparkSession, sf_dir: str, template) -> DataFrame:
    return spark.sql(template(Spark(sf_dir, spark)))


def sql(template) -> str:
    return template(Duck())
