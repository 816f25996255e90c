"""Named queries of the numbered operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.llm.common import held_out, table
from reviewlens.llm import chat, decontaminate, langid, mixing, pieces, quality, repair, secrets, sharding, simhash, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", "epoch", "block", "mix_key")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    model = toxicity.learn(docs.where(~out), table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",").alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    parts = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(parts(base).cast("binary"), 256).alias("base_sha256"), parts(F.col("spans")).alias("spans"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return chat.read_back(chat.format_conversations(given.union(probe)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.split_by_bytes(docs, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "words", "share", "same_values")


def op10_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    languages, weights = langid.learn(langid.training_rows(docs.select("doc_id", "text", "lang"), out))
    found = langid.predict(docs.select("doc_id", "text"), languages, weights)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = vector_codes.learn_codes(table(spark, sf_dir, "embeddings"), keep=("label",))
    return vector_codes.label_errors(learnt).withColumn("codebooks_sha256", F.lit(learnt.fingerprint))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return pieces.decode(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.diagnosed(repair.damage(given)))


QUERIES: dict[str, Query] = {
    "op1_temperature_mix": op1_temperature_mix,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_warc": op6_warc,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_templates": op9_templates,
    "op10_gru_language": op10_gru_language,
    "op11_vector_codes": op11_vector_codes,
    "op12_pieces": op12_pieces,
    "op13_repair": op13_repair,
}


def _vector_codes_sql(rounds: int = 6) -> str:
    """One common table for every assignment and every update; parts are spelt out component by component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row, position, min(distance * 256 + entry) AS best FROM (
    SELECT p.row, p.position, b.entry, sum((p.c - b.c) * (p.c - b.c)) AS distance
    FROM parts p JOIN book{r} b USING (position, i) GROUP BY ALL) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT position, entry, i, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT position, CAST(best % 256 AS BIGINT) AS entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c
    FROM parts JOIN near{r} USING (row, position) GROUP BY ALL) m USING (position, entry, i))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT row, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS nth, len(embedding) // 8 AS width FROM kept),
parts AS MATERIALIZED (SELECT row, vec_id, nth // width AS position, nth % width AS i, CAST(floor(4096 * x::DOUBLE) AS BIGINT) AS c FROM cells),
book0 AS MATERIALIZED (
  SELECT position, entry, i, c FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16) USING (vec_id)),
{", ".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', CAST(best % 256 AS INTEGER)), '' ORDER BY position) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY position, entry, i)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row)"""


def _repair_sql() -> str:
    """The same costs without shared nodes: each state holds its cost in ten digits and its audit as one string, so the least string wins."""
    add = lambda x, cost, letter: f"lpad((left({x}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({x}, 11) || '{letter}'"
    best = lambda *xs: f"least({', '.join(xs)})"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    keep = lambda initial, *states: [when(f"NOT gone AND role[1] = '{initial}'", add(s, "extra", "K")) for s in states]
    fit = lambda *states: [when("NOT gone", add(s, "extra + 1", "R")) for s in states]
    user = lambda u, *states: best(u, *[add(s, 5, "I") for s in states])
    step = f"""SELECT conv_id, n, u0_start AS start, u0_system AS system, {user('u0_user', 'u0_start', 'u0_system', 'u0_assistant')} AS "user", u0_assistant AS assistant FROM (
      SELECT r.conv_id, r.n, {add('start', 2, 'D')} AS u0_start, {best(add('system', 2, 'D'), *keep('s', 'start'))} AS u0_system,
        {best(add('"user"', 2, 'D'), *keep('u', 'start', 'system', 'assistant'), *fit('start', 'system', 'assistant'))} AS u0_user,
        {best(add('assistant', 2, 'D'), *keep('a', '"user"'), *fit('"user"'))} AS u0_assistant
      FROM run b JOIN faults r ON r.conv_id = b.conv_id AND r.n = b.n + 1)"""
    return f"""WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS x, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS steps FROM bits WHERE k = 8),
fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fate FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn::BIGINT AS turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM fates, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) c(copy) WHERE fate <> 0),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
faults AS MATERIALIZED (
  SELECT *, blank OR seen AS gone, seen AND NOT blank AS duplicate, cut AND NOT blank AND NOT seen AS truncated,
    CASE WHEN cut AND NOT blank AND NOT seen THEN 5 ELSE 0 END AS extra FROM marked),
run AS (
  SELECT conv_id, 0::BIGINT AS n, '0000000000' AS start, NULL::VARCHAR AS system, '0000000005I' AS "user", '0000000010II' AS assistant
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, n, start, system, "user", {best('assistant', add('"user"', 5, 'I'))} FROM ({step})),
ends AS (
  SELECT conv_id, left(won, 10)::BIGINT AS cost, substr(won, 11) AS audit FROM (
    SELECT conv_id, {best('start', 'assistant')} AS won FROM run QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS at_letter FROM ends WHERE audit <> ''),
edits AS (
  SELECT l.conv_id, letter, at_letter, CASE WHEN letter <> 'I' THEN count(*) FILTER (WHERE letter <> 'I') OVER w END AS n,
    count(*) FILTER (WHERE letter <> 'D') OVER w AS place FROM letters l WINDOW w AS (PARTITION BY conv_id ORDER BY at_letter)),
turns AS (
  SELECT e.conv_id, e.at_letter, e.letter, e.place, coalesce(f.role, '') AS role, coalesce(f.text, '') AS text,
    max((e.place = 1 AND e.letter = 'K' AND f.role[1] = 's')::INT) OVER (PARTITION BY e.conv_id) AS opened
  FROM edits e LEFT JOIN faults f ON f.conv_id = e.conv_id AND f.n = e.n WHERE e.letter <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY at_letter) AS whole FROM turns GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM faults GROUP BY conv_id)
SELECT conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, cost, audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id) LEFT JOIN told USING (conv_id)"""


_WARC_SQL = """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM placed"""

ORACLES: dict[str, str] = {
    "op6_warc": _WARC_SQL,
    "op11_vector_codes": _vector_codes_sql(),
    "op13_repair": _repair_sql(),
}
