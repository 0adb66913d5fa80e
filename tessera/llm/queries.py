"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, mixing, packing, periodic, quality, sharding, simhash, substring, toolcalls, toxicity
from .lines import LineIndex
from .shared import table

#: Documents of an arrival, on average, in order of their ids.
ARRIVAL = 512
#: The one tool of the conversations' derived calls; ``after``: the call that it comes after, if there is one.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": ["string", "null"]}}}}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), digests=True)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.PermutationIndex(vectors, k=5).search(vectors.filter("vec_id % 50 = 0"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).drop("text")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", toxicity.held_out().alias("held_out"), "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir)).drop("text")


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls of their own, so each is read as calls of one tool: a
    user's turn t calls ``reply`` as ``call_t``, refers to the user's call two turns before, if there
    is one, so that calls have an order, and is answered as ``call_t`` by the assistant's turn t + 1."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = turns.filter("role = 'user'")
    before = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.struct(F.concat(F.lit("call_"), "turn").alias("$ref")).alias("after")).distinct()
    arguments = F.to_json(F.struct("after", "text", "turn"), {"ignoreNullFields": "false"})
    calls = users.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat(F.lit("call_"), "turn").alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return toolcalls.link(calls, results, REPLY).drop("problem")


def op7_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of ``ARRIVAL`` documents become shards, then full tiers are merged; returns where each document lies."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark)
    # As many arrivals as ARRIVAL documents each make, over the range of the ids: sparse ids don't make more of them.
    n, low, high = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, (high - low + 1) * ARRIVAL // max(1, n)) if n else 1
    store.append(docs, F.floor((F.col("doc_id") - F.lit(low or 0)) / width))
    store.compact(docs.schema)
    rows = store.read(docs.schema)
    return rows.select("doc_id", F.col("gen").cast("long").alias("gen"), "shard", "n_rows", "n_bytes", F.col("tier").cast("long").alias("tier"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return LineIndex(spark).deduplicate(docs, digests=True)


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def replanted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a tenth of the ids, by checksum, have words replaced from one place on by repeats of a stretch.

    A null id has no checksum, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    words = words.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    at = words.withColumn("a", F.expr("IF(n > 0, g % n, 0L)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(replanted(table(spark, sf_dir, "documents")), digests=True)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_compression_bands, op3_permutation_index, op4_byte_bpe, op5_toxicity, op6_tool_call_linking, op7_size_tiered_compaction, op8_line_dedup, op9_entropy_balancing, op10_simhash_pigeonring, op11_source_divergence, op12_periodic_runs, op13_mixture_packing)}

_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS seq FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, rank() OVER (PARTITION BY seq ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
marked AS (SELECT p.doc_id, p.i, p.word, max(l.s) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM places p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.s = p.i),
told AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN told t ON t.doc_id = w.doc_id
"""

_OP6 = r"""
WITH RECURSIVE calls AS (SELECT conv_id, turn, 'call_' || turn AS call_id, text FROM conversations WHERE role = 'user'),
told AS (SELECT c.*, b.call_id AS after FROM calls c LEFT JOIN (SELECT DISTINCT conv_id, turn, call_id FROM calls) b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
ordered AS (SELECT conv_id, turn, 0 AS depth FROM told WHERE after IS NULL
  UNION SELECT t.conv_id, t.turn, o.depth + 1 FROM told t JOIN ordered o ON o.conv_id = t.conv_id AND o.turn = t.turn - 2 WHERE t.after IS NOT NULL),
results AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
first AS (SELECT conv_id, call_id, count(*) AS n_results, min(struct_pack(turn := turn, content := text)) AS f FROM results GROUP BY ALL)
SELECT c.conv_id, c.turn, c.call_id, 'reply' AS name, c.text IS NOT NULL AS valid, o.depth, coalesce(f.n_results, 0) AS n_results, f.f.turn AS result_turn,
  '{"arguments":{"after":' || coalesce('{"$ref":"' || c.after || '"}', 'null') || ',"text":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"reply","result":' || coalesce(CAST(to_json(f.f.content) AS VARCHAR), 'null') || '}' AS canonical
FROM told c LEFT JOIN ordered o ON o.conv_id = c.conv_id AND o.turn = c.turn LEFT JOIN first f ON f.conv_id = c.conv_id AND f.call_id = c.call_id
"""

_OP7 = f"""
WITH width AS (SELECT min(doc_id) AS low, greatest(1, (max(doc_id) - min(doc_id) + 1) * {ARRIVAL} // greatest(1, count(doc_id))) AS w FROM documents),
dealt AS (SELECT d.doc_id, d.text, coalesce((d.doc_id - w.low) // w.w, -1) AS shard FROM documents d, width w),
arrivals AS (SELECT shard, count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes FROM dealt GROUP BY 1),
tiers AS (SELECT *, CAST(greatest(0, ceil(ln(greatest(n_bytes, 1) / {sharding.SMALL}) / ln({sharding.FANOUT}.0))) AS BIGINT) AS tier FROM arrivals),
full_tiers AS (SELECT *, sum(n_bytes) OVER (PARTITION BY tier ORDER BY shard ROWS UNBOUNDED PRECEDING) - n_bytes AS before
  FROM (SELECT *, count(*) OVER (PARTITION BY tier) AS n FROM tiers WHERE n_bytes < {sharding.TARGET}) WHERE n >= {sharding.FANOUT}),
plan AS (SELECT shard, CAST(tier * 4294967296 + floor(before / {sharding.TARGET}) AS BIGINT) AS moved FROM full_tiers),
placed AS (SELECT a.*, CASE WHEN p.moved IS NULL THEN 1 ELSE 2 END AS gen, coalesce(p.moved, a.shard) AS final FROM arrivals a LEFT JOIN plan p ON p.shard = a.shard),
sized AS (SELECT gen, final, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM placed GROUP BY 1, 2)
SELECT d.doc_id, CAST(p.gen AS BIGINT) AS gen, p.final AS shard, s.n_rows, s.n_bytes,
  CAST(greatest(0, ceil(ln(greatest(s.n_bytes, 1) / {sharding.SMALL}) / ln({sharding.FANOUT}.0))) AS BIGINT) AS tier
FROM dealt d JOIN placed p ON p.shard = d.shard JOIN sized s ON s.gen = p.gen AND s.final = p.final
"""

_OP8 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
counts AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN counts c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
per_doc AS (SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS c
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
vocabulary AS (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM per_doc GROUP BY 1, 2 HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM vocabulary GROUP BY 1),
counts AS (SELECT p.lang, p.source, p.term, CAST(sum(p.c) AS HUGEINT) AS c FROM per_doc p JOIN vocabulary USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY 1, 2),
dense AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (coalesce(t.n, 0) + 2 * s.v) AS p, 1 + 1000000000 * (v.c + 2) // (s.n + 2 * s.v) AS q
  FROM groups g JOIN vocabulary v ON v.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_CRC = "xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda c: ord(c)), lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + _CRC.format("CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
places AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
agreeing AS (SELECT x.r, y.i - x.i AS q, x.i FROM places x JOIN places y ON y.r = x.r AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM agreeing) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM islands GROUP BY ALL),
best AS (SELECT r, start, length, period, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS nth FROM runs),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.r, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM places p ANTI JOIN gone USING (r, i) GROUP BY p.r)
SELECT w.doc_id, CAST(coalesce(t.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM words w LEFT JOIN told t ON t.r = w.r LEFT JOIN best b ON b.r = w.r AND b.nth = 1 LEFT JOIN kept k ON k.r = w.r
"""

SQL = {"op1_substring_dedup": _OP1, "op6_tool_call_linking": _OP6, "op7_size_tiered_compaction": _OP7, "op8_line_dedup": _OP8, "op11_source_divergence": _OP11, "op12_periodic_runs": _OP12}
