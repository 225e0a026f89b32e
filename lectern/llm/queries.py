"""The queries of this subpackage, one for each numbered operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, exact, html_text, langid, media, mixing, packing, pii, quality, runs, simhash, tokencount, trie
from lectern.llm.common import WORD, id_remainder, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn_languages(docs)
    found = docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), model.predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.decode_media(media.encode_media(read(spark, sf_dir, "documents")), tensors=False)
    return files.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.learn_quality(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), model.score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def _named_spans(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind.removesuffix("s")), s["start"], s["end"]))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    named = {k: _named_spans(k) for k in [*pii.KINDS, "terms"]}
    base = F.concat(*[named[k] for k in pii.KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, named["terms"]), ",").alias("spans"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html_text.extract("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given conversation -1 would go on with the two added turns, as the conversation that they belong to."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(rows.unionByName(own))
    turns = chats.select("conv_id", "formatted", chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"), chat.read_turns(F.col("formatted")).alias("turns"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tenth document, by its id's crc32, the words from some place on are repeated with a period first; a null id has none."""
    docs, h = read(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    again = runs.repeat_words(F.col("text"), lambda n: g % n, lambda n, a: 1 + F.floor((n - a) / (3 + g % 8)))
    changed = docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(WORD), again).otherwise(F.col("text")))
    found = runs.periodic_runs(changed).withColumn("best", runs.best_run(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_nodes(trie.with_shared_heads(trie.conversation_turns(read(spark, sf_dir, "conversations"))))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Query]:
    every = (op1_pack, op2_language, op3_simhash, op4_media, op5_quality, op6_exact, op7_pii, op8_html, op9_mix, op10_chat, op11_runs, op12_trie, op13_tokens)
    return {f.__name__: f for f in every}


OP6 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, first_value(n) OVER w AS most
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND n = most) AS kept, text_sha256 FROM g
"""

OP10 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS starts, row_number() OVER w AS place,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_n,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_n + CASE WHEN starts THEN 12 + role_n + 1 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sums
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight > source_size * 3.0::DOUBLE THEN source_size * 3.0::DOUBLE
    ELSE weight * first_value(CASE WHEN NOT level * weight > source_size * 3.0::DOUBLE THEN level END IGNORE NULLS) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target
  FROM levels
), placed AS (
  SELECT row_number() OVER () AS row_id, s.doc_id, s.source, s.size, s.place, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS given
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queued AS (
  SELECT row_id, size, sum(size) OVER (ORDER BY CAST(pass * source_size + given AS DOUBLE) / target, source ASC NULLS LAST, place, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS reached
  FROM placed, (VALUES (0), (1), (2)) AS p(pass) WHERE size > 0
), copies AS (
  SELECT row_id, count(*) AS copies FROM queued WHERE reached <= (SELECT sum(size) FROM sized) GROUP BY row_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken FROM placed LEFT JOIN copies USING (row_id)
"""


#: crc32 bit by bit: a byte of the text is mixed in by xor, and each -1 after it moves the sum by one bit.
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: -1::BIGINT))))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT)"

OP12 = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id AS c, list({{'id': id, 'words': words}} ORDER BY i) AS turns FROM t GROUP BY conv_id
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns
  FROM (SELECT *, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM own) a LEFT JOIN own b ON b.c = a.c - a.c % 20
), begun AS (
  SELECT c, d, len(turns) = d AS ends, array_to_string(list_transform(turns[1:d], lambda x: x.id), '') AS path, CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT path, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends_
  FROM begun GROUP BY path
), above AS (
  SELECT substr(path, 1, 64 * up) AS path, depth = up + 1 AS child, (n_convs - 1) * words AS saved, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.depth = n.depth + 1 AND substr(k.path, 1, length(k.path) - 64) = n.path) AS leaf
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes) n
), sums AS (
  SELECT path, count(*) FILTER (child) AS n_children, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends_) AS ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = substr(n.path, 1, length(n.path) - 64)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact": OP6, "op9_mix": OP9, "op10_chat": OP10, "op12_trie": OP12}
