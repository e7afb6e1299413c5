"""Registered queries of the training-data operators, and their oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, chat_format, decontaminate, langid, licences, linededup, periodic, quality, resample, simhash, substrings, urlfilter, vecdedup
from orrery.session import checkpoint

TOKENIZER = "byte_bpe_50k.json"
LINE_BATCHES = 4
MIN_LINE_DOCS = 10

#: Tools that the query knows; calls of others are reported as unknown.
TOOLS = {
    "search": {
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": ["integer", "null"], "minimum": 1, "maximum": 50},
            "sort": {"enum": ["date", "size"]},
        },
        "required": ["query"],
        "additionalProperties": False,
    },
    "calculator": {
        "properties": {
            "expression": {
                "type": "object",
                "properties": {"op": {"type": "string", "enum": ["add", "mul"]}, "values": {"type": "array", "items": {"type": "integer"}}},
                "required": ["op", "values", "unit"],
            }
        },
        "required": ["expression"],
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` as chats with tools: every turn is kept, and calls and answers are made of the turns.

    The table itself holds plain text only.  With ``n`` the length of a text:

    * An assistant turn becomes ``{"content", "tool_calls"}`` with one call, two if 5 divides
      ``n``.  Call ``k`` has the id ``c<turn>-<k>``, or ``again`` if ``n % 7 = 3``, and is of
      ``search`` (``(n + k) % 4`` is 0 or 1), ``calculator`` (2) or ``translate``, which no
      schema knows.  A search has the text's first 20 characters as ``query`` (none if 11
      divides ``n``), a ``limit`` of ``n % 60`` (as a string if 6 divides ``n``) and a ``sort``
      by ``n % 3``; a calculation has ``op`` by ``n % 2`` and the values ``n``, ``k``, ``n / 2``.
    * A user turn after the first stays, and is followed by a ``tool`` message of the same
      turn and text that answers ``c<turn - 1>-0``, ``lost`` if 9 divides ``n``, or ``again``
      if 10 does.
    """
    n, turn = F.coalesce(F.length("text"), F.lit(0)), F.col("turn").cast("string")

    def call(k: int):
        search = F.struct(
            F.when(n % 11 != 0, F.substring("text", 1, 20)).alias("query"),
            F.when(n % 6 != 0, n % 60).alias("limit"),
            F.when(n % 3 == 0, "date").when(n % 3 == 1, "size").otherwise("none").alias("sort"),
        )
        spoilt = F.struct(search["query"].alias("query"), (n % 60).cast("string").alias("limit"), search["sort"].alias("sort"))
        values = F.array(n.cast("double"), F.lit(float(k)), n / 2)
        calculation = F.struct(F.struct(values.alias("values"), F.when(n % 2 == 0, "add").otherwise("pow").alias("op")).alias("expression"))
        which = (n + k) % 4
        arguments = F.when(which == 2, F.to_json(calculation)).when(n % 6 == 0, F.to_json(spoilt)).otherwise(F.to_json(search))
        name = F.when(which < 2, "search").when(which == 2, "calculator").otherwise("translate")
        call_id = F.when(n % 7 == 3, "again").otherwise(F.concat(F.lit("c"), turn, F.lit(f"-{k}")))
        return F.struct(name.alias("name"), call_id.alias("id"), arguments.alias("arguments"))

    calls = F.when(n % 5 == 0, F.array(call(0), call(1))).otherwise(F.array(call(0)))
    made = F.concat(F.lit("\n "), F.to_json(F.struct(calls.alias("tool_calls"), F.col("text").alias("content"))))
    said = conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", made).otherwise(F.col("text")).alias("text"))
    answered = F.when(n % 9 == 0, "lost").when(n % 10 == 0, "again").otherwise(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"), F.lit("-0")))
    answers = conversations.where("role = 'user' AND turn > 0").select(
        "conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(F.col("text").alias("content"), answered.alias("tool_call_id"))).alias("text")
    )
    return said.unionByName(answers)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = checkpoint(tool_conversations(table(spark, sf_dir, "conversations")))
    return chat_format.format_chat(chats, chat_format.tool_table(spark, TOOLS))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    hits = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(remainder(5) != 0))
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "background")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_table(spark, docs, tokenizer_path(), ids=False).drop("text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urlfilter.train(urlfilter.labelled_urls(spark))
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), weights)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, LINE_BATCHES, MIN_LINE_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(remainder(4) != 2))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, longest=1, seed=2024)


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic tails in every tenth text, by the rule of the query.

    With ``h`` the checksum of the id and ``g = h // 10``, a text of ``n`` words whose ``h`` ends in 0
    repeats the ``p`` words from word ``a`` on up to its end; ``a = g % n``,
    ``p = 1 + (n - a) // (3 + g % 8)``.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tailed(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tailed(w))), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, made).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.detect_runs(docs, min_length=6, copies=4)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    own = (
        op1_chat_format,
        op2_simhash,
        op3_decontaminate,
        op4_language,
        op5_bpe,
        op6_url_filter,
        op7_line_dedup,
        op8_embedding_dedup,
        op9_license_scan,
        op10_quality,
        op11_resample,
        op12_periodic_runs,
        op13_substring_dedup,
    )
    return {f.__name__: f for f in own}


ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {ASCII_LOWER.format(f"trim(line, {BLANKS})")} AS k FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_LINE_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(h.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h ON keyed.k = h.k GROUP BY doc_id
"""

WORDS_SQL = "regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n
), hits AS (
  SELECT doc_id, s, p.n, item FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM places) p
  JOIN windows USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""

#: The checksum of bytes by its table, which is made by rule.
CHECKSUM_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) AS r(n))
)"""
BYTES = "list_transform(range(octet_length(encode({0}))), lambda k: CAST('0x' || substr(hex(encode({0})), 2 * k + 1, 2) AS BIGINT))"
CHECKSUM = "xor(list_reduce(" + BYTES + ", lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"

RESAMPLE_SQL = f"""
WITH {CHECKSUM_TABLE},
doc_words AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
item_words AS (SELECT unnest({WORDS_SQL}) AS word FROM benchmark),
buckets AS (
  SELECT word, {CHECKSUM.format("word")} % 10000 AS bucket FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words), crc_table
), s AS (
  SELECT bucket, count(*) AS s FROM doc_words JOIN buckets USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM item_words JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
         / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN drawn ON scored.doc_id = drawn.doc_id
"""

BLANK_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
RUNS_SQL = f"""
WITH {CHECKSUM_TABLE},
given AS (
  SELECT doc_id, {BLANK_WORDS} AS w, {CHECKSUM.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table
), cut AS (
  SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM given
), tailed AS (
  SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) AS w FROM cut
), words AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM tailed
), pairs AS (
  SELECT a.doc_id, b.i - a.i AS p, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM pairs) GROUP BY doc_id, p, g
), runs AS (
  SELECT doc_id, start, length, min(p) AS p FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / p DESC, start, p) = 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, p AS period, 1000 * length // p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

SUBSTRING_SQL = f"""
WITH given AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM given)
), twice AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS i FROM windows JOIN twice USING (win)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM given
), kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT u.vec_id, (SELECT count(*) FROM links WHERE a = u.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = u.vec_id AS kept
FROM u JOIN reach r ON r.a = u.vec_id GROUP BY u.vec_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    line = "'  ' || regexp_replace(" + ASCII_LOWER.format("{x}") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') || '  '"
    for old, new in licences.SPELLINGS:
        line = f"replace({line}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    line = f"replace(trim({line}), '  ', ' ')"
    copyright_line = " OR ".join(f"starts_with(x, {_quoted(p)})" for p in licences.COPYRIGHT)
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: {line.format(x='y')}), lambda x: length(x) > 0 AND NOT ({copyright_line}))"
    known = ", ".join(f"({_quoted(k)}, {_quoted(i)}, {_quoted(t)})" for k, i, t in licences.KNOWN)
    return f"""
WITH known AS (
  SELECT kind, min(license_id) AS license_id, c FROM (
    SELECT kind, license_id, array_to_string({lines}, ' ') AS c FROM (VALUES {known}) AS t(kind, license_id, text)) GROUP BY kind, c
), docs AS (SELECT doc_id, {lines} AS ls FROM documents),
whole AS (SELECT doc_id, ls, CASE WHEN len(ls) > 0 THEN array_to_string(ls, ' ') END AS c FROM docs),
named AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices
  FROM (SELECT DISTINCT d.doc_id, k.license_id FROM (SELECT doc_id, unnest(ls) AS l FROM docs) d JOIN known k ON k.kind = 'line' AND k.c = d.l) GROUP BY doc_id
)
SELECT w.doc_id, sha256(w.c) AS text_sha256, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM whole w LEFT JOIN known k ON k.kind = 'text' AND k.c = w.c LEFT JOIN named n ON n.doc_id = w.doc_id
"""


#: The rules of ``tool_conversations`` and of ``TOOLS``, written out.
CHAT_SQL = """
WITH said AS (
  SELECT *, coalesce(length(text), 0) AS n FROM conversations
), calls AS (
  SELECT conv_id, turn, text, n, k, CASE WHEN n % 7 = 3 THEN 'again' ELSE 'c' || turn || '-' || k END AS id, (n + k) % 4 AS which
  FROM said, (VALUES (0), (1)) AS t(k) WHERE role = 'assistant' AND (k = 0 OR n % 5 = 0)
), answers AS (
  SELECT conv_id, turn, text, CASE WHEN n % 9 = 0 THEN 'lost' WHEN n % 10 = 0 THEN 'again' ELSE 'c' || (turn - 1) || '-0' END AS id
  FROM said WHERE role = 'user' AND turn > 0
), firsts AS (
  SELECT conv_id, id, min(turn * 2 + k) AS place FROM calls GROUP BY ALL
), answered AS (
  SELECT conv_id, id, min(turn) AS at FROM answers GROUP BY ALL
)
SELECT conv_id, 'message' AS kind, turn, -1 AS item, CAST(NULL AS VARCHAR) AS call_id, turn AS at_turn, 0 AS step, 'ok' AS status, '' AS errors,
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN role IS NULL THEN '' ELSE ',' END END
           || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) END || '}' AS json
FROM said
UNION ALL
SELECT c.conv_id, 'call', turn, k, c.id, turn, 1,
       CASE WHEN place < turn * 2 + k THEN 'duplicate' WHEN a.id IS NULL THEN 'unanswered' ELSE 'ok' END,
       CASE WHEN which = 3 THEN 'unknown tool'
            WHEN which = 2 THEN array_to_string(list_filter([CASE WHEN n % 2 = 1 THEN 'enum of expression.op' END, 'missing expression.unit',
                 CASE WHEN n % 2 = 1 THEN 'type of expression.values[]' END], lambda x: x IS NOT NULL), ',')
            ELSE array_to_string(list_filter([CASE WHEN n % 3 = 2 THEN 'enum of sort' END, CASE WHEN n % 6 <> 0 AND n % 60 > 50 THEN 'maximum of limit' END,
                 CASE WHEN n % 11 = 0 THEN 'missing query' END, CASE WHEN n % 6 = 0 THEN 'type of limit' END], lambda x: x IS NOT NULL), ',') END,
       '{"arguments":' || CASE
         WHEN which = 2 THEN '{"expression":{"op":"' || CASE WHEN n % 2 = 0 THEN 'add' ELSE 'pow' END || '","values":[' || n || ',' || k || ',' || (n // 2) || CASE WHEN n % 2 = 1 THEN '.5' ELSE '' END || ']}}'
         ELSE '{"limit":' || CASE WHEN n % 6 = 0 THEN '"' || (n % 60) || '"' ELSE CAST(n % 60 AS VARCHAR) END
              || CASE WHEN n % 11 = 0 THEN '' ELSE ',"query":' || CAST(to_json(left(text, 20)) AS VARCHAR) END
              || ',"sort":"' || CASE n % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'size' ELSE 'none' END || '"}' END
         || ',"id":"' || c.id || '","name":"' || CASE WHEN which < 2 THEN 'search' WHEN which = 2 THEN 'calculator' ELSE 'translate' END || '"}'
FROM calls c JOIN firsts f ON c.conv_id = f.conv_id AND c.id = f.id LEFT JOIN answered a ON c.conv_id = a.conv_id AND c.id = a.id
UNION ALL
SELECT r.conv_id, 'result', turn, -1, r.id, CASE WHEN place // 2 > turn THEN place // 2 ELSE turn END, 2,
       CASE WHEN place IS NULL THEN 'orphan' WHEN turn > a.at THEN 'duplicate' ELSE 'ok' END, '',
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"role":"tool","tool_call_id":"' || r.id || '"}'
FROM answers r LEFT JOIN firsts f ON r.conv_id = f.conv_id AND r.id = f.id JOIN answered a ON r.conv_id = a.conv_id AND r.id = a.id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": CHAT_SQL,
        "op3_decontaminate": CONTAMINATION_SQL,
        "op7_line_dedup": LINES_SQL,
        "op8_embedding_dedup": VECTORS_SQL,
        "op9_license_scan": _licence_sql(),
        "op11_resample": RESAMPLE_SQL,
        "op12_periodic_runs": RUNS_SQL,
        "op13_substring_dedup": SUBSTRING_SQL,
    }
