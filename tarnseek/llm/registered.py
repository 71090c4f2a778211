"""The queries of this package, each over whole tables, and the SQL to match where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnseek.llm import chat, decontamination, embedding_graph, licences, line_spread, periodic, pieces, quality, simhash, spelling, token_files, toxicity, warc
from tarnseek.llm.common import let, text_of
from tarnseek.llm.licence_texts import EQUIVALENTS, NOTICES, TEXTS

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, whether it fails the base rules, and whether it is kept."""
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as read back from the archives."""
    rows = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")))
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and the text they decode to, as digests."""
    rows = pieces.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select(
        "doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document within benchmark windows, and the items they come from."""
    rows = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items = F.size("item_ids").cast("long")
    return rows.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word of each document, how many of them went as boilerplate, and a digest of what is left."""
    rows = line_spread.without_boilerplate(_table(spark, sf_dir, "documents"))
    left = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    return rows.select("doc_id", F.col("_tsk_lines").alias("n_lines"), F.col("_tsk_removed").alias("n_removed"), left.alias("text_sha256"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is a copy of, and those that its lines name."""
    rows = licences.scan(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "licence", F.array_join("notices", ",").alias("notices"), "n_notices")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a canonical JSON message: users' turns as tool calls, the turns after them as their results."""
    rows = chat.link(chat.turns_as_calls(_table(spark, sf_dir, "conversations")), chat.ANSWER_TOOL)
    whole = [F.col(c).cast("long").alias(c) for c in ("level", "block", "step")]
    return rows.select("conv_id", "turn", "kind", "call_id", "status", "valid", *whole, "json")


#: A tool with nested arguments.
NOTE_TOOL = {
    "note": {
        "type": "object", "required": ["body", "size"], "additionalProperties": False,
        "properties": {
            "body": {"type": "string", "minLength": 40, "pattern": "[a-z]"},
            "size": {"type": "integer", "minimum": 0, "maximum": 400},
            "about": {
                "type": "object", "required": ["who"],
                "properties": {"who": {"enum": ["user", "system", 3, None]}, "marks": {"type": "array", "items": {"type": ["integer", "null"], "exclusiveMaximum": 5}, "maxItems": 3}},
            },
        },
    }
}


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written as JSON in the texts of turns, and their results in the turns after them, against a nested schema."""
    turns = _table(spark, sf_dir, "conversations")
    size, turn = F.char_length("text"), F.col("turn").cast("long")
    marks = F.transform(F.sequence(F.lit(1), F.lit(1) + (turn % 4).cast("int")), lambda i: F.when(i != 2, i + size % 3))
    arguments = F.to_json(F.struct(F.col("text").alias("body"), size.alias("size"), F.struct(F.col("role").alias("who"), marks.alias("marks")).alias("about")), {"ignoreNullFields": "false"})
    call = F.struct(F.concat(F.lit("c"), turn).alias("id"), F.lit("note").alias("name"), arguments.alias("arguments"))
    is_call = turn % 2 == 0
    told = F.struct(F.concat(F.lit("c"), turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    said = F.when(is_call, F.to_json(F.struct(F.array(call).alias("tool_calls")))).otherwise(F.to_json(told))
    written_out = turns.select("conv_id", turn.alias("turn"), F.when(is_call, "assistant").otherwise("tool").alias("role"), said.alias("text"))
    rows = chat.link(chat.events_of(written_out), NOTE_TOOL)
    return rows.select("conv_id", "turn", "kind", "call_id", "status", "valid")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, learned from the labelled ones that aren't held out."""
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of each document."""
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids start in the token files, how many there are, and their checksum as read back."""
    index = token_files.write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    rows = token_files.document_starts(index, token_files.read_tokens(index))
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of each document, the one of greatest exponent, and digests of all runs and of the collapsed text.

    In the documents that the contract names, the words from some place on are first made periodic.
    """
    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    words = F.regexp_extract_all(text_of(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def made_periodic(x):
        n = F.size(x["w"])
        a = F.pmod(x["g"], n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + x["g"] % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, x["w"][i]).otherwise(x["w"][(a + (i - a) % p).cast("int")]))
        return F.when(n > 0, F.array_join(places, " ")).otherwise("")

    text = F.when(h % 10 == 0, let(F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g")), made_periodic)).otherwise(F.col("text"))
    rows = periodic.collapse(docs.select("doc_id", text.alias("text")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.reduce("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode("listed", "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate class of each vector."""
    return embedding_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent long words of all documents, with the usual form that each is a slip of.

    In the occurrences that the contract names, a letter is left out: those of a run in a document whose checksum 199 divides.
    """
    runs = spelling.runs_of(_table(spark, sf_dir, "documents"))
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "utf-8"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substring("run", at + 2, F.char_length("run")))
    return spelling.variants(spelling.vocabulary(F.when(h % 199 == 0, shorter).otherwise(F.col("run")), runs))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_files": op10_token_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
    "chat_tool_calls": chat_tool_calls,
}

_ITEM_WORDS = r"""[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"""



def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licences.COPYRIGHT_LINE}', '\\1', 'g')"
    out = rf"trim(regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    for other, usual in EQUIVALENTS:
        out = f"replace({out}, '{other}', '{usual}')"
    return out


def _sql_values(known: dict[str, list[str]]) -> str:
    return ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, texts in known.items() for t in texts)


SQL: dict[str, str] = {
    "op2_warc": """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (
  SELECT *, strlen(coalesce(html, '')) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again
  FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
""",
    "op6_licence_scan": rf"""
WITH whole AS (SELECT c, min(name) AS name FROM (SELECT name, {_sql_canonical("t")} AS c FROM (VALUES {_sql_values(TEXTS)}) AS v(name, t)) GROUP BY c),
part AS (SELECT c, min(name) AS name FROM (SELECT name, {_sql_canonical("t")} AS c FROM (VALUES {_sql_values(NOTICES)}) AS v(name, t)) GROUP BY c),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
found AS (SELECT doc_id, name FROM (SELECT doc_id, {_sql_canonical("line")} AS c FROM lines WHERE regexp_matches(line, '[A-Za-z]')) JOIN part USING (c)),
named AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n_notices FROM found GROUP BY doc_id)
SELECT doc_id, whole.name AS licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM (SELECT doc_id, {_sql_canonical("text")} AS c FROM d) LEFT JOIN whole USING (c) LEFT JOIN named USING (doc_id)
""",
    "op7_chat_format": """
WITH e AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, to_json(text) AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'c' || turn WHEN 'assistant' THEN 'c' || (turn - 1) END AS call_id
  FROM conversations),
chains AS (SELECT conv_id, call_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM e WHERE kind = 'call'),
levels AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM chains),
answered AS (SELECT conv_id, call_id FROM e WHERE kind = 'result')
SELECT e.conv_id, e.turn, kind, e.call_id,
  CASE kind WHEN 'call' THEN CASE WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END
    WHEN 'result' THEN CASE WHEN l.call_id IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'message' END AS status,
  CASE WHEN kind = 'call' THEN true END AS valid, coalesce(level, 0) AS level,
  CASE WHEN kind = 'result' AND l.call_id IS NOT NULL THEN e.turn - 1 ELSE e.turn END AS block,
  CAST(CASE kind WHEN 'call' THEN 1 WHEN 'result' THEN 2 ELSE 0 END AS BIGINT) AS step,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"prompt":' || text || ',"turn":' || e.turn || '},"call_id":"' || e.call_id || '","name":"answer","role":"user"}'
    WHEN 'result' THEN '{"call_id":"' || e.call_id || '","content":' || text || ',"role":"assistant"}'
    ELSE '{"content":' || text || ',"role":' || to_json(role) || '}' END AS json
FROM e LEFT JOIN levels l USING (conv_id, call_id) LEFT JOIN answered a USING (conv_id, call_id)
""",
    "chat_tool_calls": """
WITH e AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, length(text) AS size FROM conversations),
c AS (SELECT conv_id, turn FROM e WHERE turn % 2 = 0), r AS (SELECT conv_id, turn FROM e WHERE turn % 2 = 1)
SELECT e.conv_id, e.turn, CASE WHEN e.turn % 2 = 0 THEN 'call' ELSE 'result' END AS kind,
  'c' || (e.turn - e.turn % 2) AS call_id,
  CASE WHEN e.turn % 2 = 0 THEN CASE WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END
    ELSE CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END END AS status,
  CASE WHEN e.turn % 2 = 0 THEN size >= 40 AND regexp_matches(text, '[a-z]') AND size <= 400 AND role IN ('user', 'system')
    AND e.turn % 4 < 3 AND len(list_filter(range(1, 2 + e.turn % 4), lambda i: i <> 2 AND i + size % 3 >= 5)) = 0 END AS valid
FROM e LEFT JOIN r ON e.conv_id = r.conv_id AND r.turn = e.turn + 1 AND e.turn % 2 = 0
  LEFT JOIN c ON e.conv_id = c.conv_id AND c.turn = e.turn - 1 AND e.turn % 2 = 1
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM l),
drops AS (SELECT line FROM w WHERE has_word GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (
  SELECT w.*, has_word AND line IN (SELECT line FROM drops) AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone
  FROM w)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(p) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS t
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(p)),
hit AS (SELECT * FROM dw WHERE (n, t) IN (SELECT n, t FROM win)),
words AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hit, unnest(range(n)) AS u(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit JOIN win USING (n, t)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
